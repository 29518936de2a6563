"""Template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The name of a field to be filled in, and the marks that template languages put around it.
FIELD = r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*[#/^&>]?\s*{FIELD}(?:[.|]\s*\w+)*\s*\}}\}}|\{{%-?\s*{FIELD}[^%{{}}]*%\}}|<%[=-]?\s*{FIELD}[^%<>]*%>|[$#]\{{\s*{FIELD}(?:[.:]\w+)*\s*\}}|%\({FIELD}\)[sdf]"
    rf"|«\s*[a-z][a-z0-9]*(?:_[a-z0-9]+)*\s*»|\[\[\s*{FIELD}\s*\]\]|\{{[a-z]{{3,}}(?:_[a-z0-9]+)*\}}|@@{FIELD}@@|__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__|\bXXX_[A-Z0-9_]+_XXX\b"
    rf"|\[(?:TODO|TBD|FIXME|TBA)\b[^\[\]]{{0,60}}\]|[\[<](?:enter|insert|add|fill in|type|choose)\s[^\[\]<>]{{1,60}}[\]>]|<\s*{FIELD}(?:\s{FIELD}){{0,3}} (?:goes )?here\s*>|\[\s*{FIELD}(?:\s{FIELD}){{0,3}} (?:goes )?here\s*\]",
    re.I,
)
#: Forms that only count in the given case (the pattern above ignores it).
LOWER_ONLY = re.compile(r"^[«{](?!\{|%)")

#: Where a placeholder can begin.
MARK = re.compile(r"[{<$#%«\[@_X]|xxx_")

# Sentences that stand in for content, by kind.
FILLER = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|\bthis is (?:a )?(?:sample|dummy|placeholder) text\b|\bsample text used to\b|\breplace this (?:paragraph|text|section|sentence)\b|\b(?:text|content|abstract|title|description)(?: of (?:the|this) \w+)? goes here\b"
    r"|\byour (?:title|text|abstract|content|name) here\b|\btype your (?:results|text|abstract|title)\b|\bdummy (?:text|paragraph)\b|\bbeispieltext\b|\bblindtext\b|\bplatzhaltertext\b|\btexte? d['’]exemple\b|\bfaux[- ]texte\b|\btexto de (?:ejemplo|relleno|muestra)\b|此处填写|在此输入|示例文本|占位文本",
    re.I,
)
NOTICE = re.compile(
    r"\b(?:enable|activate|allow|switch on|turn on|accept)\b[^.\n]{0,24}\b(?:java ?script|cookies?|scripts?|scripting)\b|\bjava ?script (?:is|has been|seems to be|appears to be|must be) (?:disabled|turned off|not enabled|blocked|required|enabled|switched off)\b"
    r"|\brequires (?:java ?script|scripts?|scripting|cookies)\b|\bwithout (?:java ?)?script(?:ing)? support\b|\bchecking (?:if )?your browser\b|\bbrowser (?:does not|doesn't) support (?:java ?script|scripts)\b"
    r"|\baktivieren sie\b[^.\n]{0,24}\b(?:javascript|cookies|skripte)\b|\b(?:activer|activez)\b[^.\n]{0,24}\b(?:javascript|cookies|scripts)\b|\b(?:active|activar|habilite|habilitar)\b[^.\n]{0,24}\b(?:javascript|cookies|scripts)\b|(?:启用|开启|打开)[^。\n]{0,12}(?:脚本|javascript|cookie)",
    re.I,
)
ERROR = re.compile(
    r"\b[45]\d\d\s*[-–—:]?\s*(?:not found|forbidden|bad gateway|service (?:temporarily )?unavailable|internal server error|gateway time-?out|unauthori[sz]ed|bad request|too many requests)\b|\b(?:http|error|fehler|erreur|error http)\s*:?\s*[45]\d\d\b\s*(?:[-–—:]|service|not|$)"
    r"|\binternal server error\b|\bservice (?:temporarily )?unavailable\b|\bbad gateway\b|\bgateway tim(?:e|ed)[- ]?out\b|\baccess (?:denied|forbidden)\b|\baccess to this (?:resource|page|document|site) is (?:denied|forbidden|restricted)\b|\btoo many requests\b|\byour session (?:has )?expired\b|\bsomething went wrong\b"
    r"|\byou (?:have|do not have|don't have) (?:no |a |an )?(?:active )?subscription\b|\b(?:page|file|document|article|pdf|resource)s? (?:you (?:asked|requested|are looking|were looking) (?:for )?)?(?:could not|cannot|can't|can not) be (?:found|located|displayed|loaded)\b|\b(?:requested|this) (?:pdf|page|file|document|article) (?:is missing|does not exist|no longer exists|is not available|was not found|has been removed)\b|\bpage not found\b|\bsite is (?:down|under) (?:for )?maintenance\b|\bverify (?:that )?you are (?:a )?human\b"
    r"|\bseite (?:wurde )?nicht gefunden\b|\bzugriff verweigert\b|\bdienst nicht verfügbar\b|\bpage introuvable\b|\baccès (?:refusé|interdit)\b|\bservice indisponible\b|\bno se ha encontrado la página\b|\bpágina no encontrada\b|\bacceso denegado\b|\bservicio no disponible\b|页面不存在|页面未找到|找不到(?:该|此)?页面|系统繁忙|访问被拒绝|拒绝访问|服务不可用|服务器(?:内部)?错误|网关超时",
    re.I,
)
# Every match of the three patterns has one of these, in lower case; texts without any are not searched.
TRIGGERS = (
    "lorem ipsum", "dolor sit amet", "sample text", "dummy", "placeholder text", "replace this", "goes here", "your title", "your text", "your abstract", "your content", "your name", "type your", "beispieltext", "blindtext", "platzhaltertext", "d'exemple", "d’exemple", "faux", "texto de",
    "此处填写", "在此输入", "示例文本", "占位文本", "script", "cookie", "skript", "脚本", "your browser", "not found", "forbidden", "gateway", "unavailable", "internal server", "unauthori", "bad request", "too many", "http", "error", "fehler", "erreur", "access denied", "access to this", "session",
    "went wrong", "subscription", "be found", "be located", "be displayed", "be loaded", "is missing", "not exist", "longer exists", "not available", "has been removed", "maintenance", "human", "nicht gefunden", "verweigert", "nicht verfügbar", "introuvable", "accès", "indisponible",
    "no se ha encontrado", "no encontrada", "acceso denegado", "no disponible", "页面", "系统繁忙", "访问", "服务", "网关",
)
WORDS = re.compile(r"[^\W\d_]{3,}")
HAN = re.compile(r"[\u3400-\u9fff]")
#: Letters of scripts that are written without spaces.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: Parts of an address that say nothing about the document.
ADDRESS_PARTS = frozenset(("pdf", "html", "htm", "www", "http", "https", "com", "org"))
PARAGRAPHS = re.compile(r"\n\s*\n")
SEGMENTS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
#: A language has a lexicon if it has this share of the documents and so many of them; its words are in KNOWN_SHARE of its documents at
#: least, topical ones in TOPIC_SHARE. So there are at most 1 / LANGUAGE_SHARE lexicons of (words a document / KNOWN_SHARE) words.
LANGUAGE_SHARE, LANGUAGE_LEAST, KNOWN_SHARE, TOPIC_SHARE, LEAST = 0.001, 20, 0.002, 0.02, 3
#: A paragraph of FILLER_WORDS or more is made-up if under FILLER_KNOWN of its words are in any lexicon; running text has several times that in function words alone.
FILLER_WORDS, FILLER_KNOWN, COVERED = 10, 0.1, 0.9
#: Words of running text beside a message from which on the document is a text that speaks of such things.
REAL_WORDS = 40
#: Words beside a message that begins its text, up to which it stands alone.
ALONE_WORDS = 12
#: Words of a first line that can be a title.
TITLE_WORDS = 20
#: Characters from which on a text without any trigger has too many words to be an unknown message: words of three letters or more
#: are at least every fifteenth of the characters of running text, two Chinese characters count as a word.
LONG = 15 * (REAL_WORDS + TITLE_WORDS)

EVIDENCE = T.StructType([T.StructField("doc", T.LongType()), T.StructField("host", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("body", T.StringType()), T.StructField("rest", T.IntegerType()), T.StructField("mismatch", T.BooleanType())])


def placeholders(text: str) -> list[str]:
    """The unfilled placeholders in ``text``."""
    found, end = [], 0
    for mark in MARK.finditer(text):
        if mark.start() >= end and (match := PLACEHOLDER.match(text, mark.start())):
            end = match.end()
            if not (LOWER_ONLY.match(match.group()) and match.group() != match.group().lower()):
                found.append(match.group())
    return found


def plain(segment: str) -> str:
    """A segment without what differs from response to response: numbers, codes, case, spacing."""
    return re.sub(r"\W+", " ", re.sub(r"\b[A-Za-z]{0,4}-?\d[\w.-]*\b", " ", segment)).strip().lower()


def n_words(text: str) -> int:
    """Words of three letters or more; two Chinese characters count as a word."""
    han = len(HAN.findall(text))
    return len(WORDS.findall(HAN.sub(" ", text) if han else text)) + (han + 1) // 2


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in WORDS.findall(text)}


def unlike(before: str, after: str, slug: str | None, rest: int) -> bool:
    """Whether what follows a title or the begin of a text shares no term with it or with the address.

    A message that begins its text, under an address without words, must stand alone.
    """
    subject = terms_of(before) | (terms_of(slug or "") - ADDRESS_PARTS)
    return not subject & terms_of(after) if subject else rest <= ALONE_WORDS


class Lexicon:
    """What is known of the corpus's languages: words of any, topical words of any, the languages themselves, and their letters."""

    def __init__(self, known: frozenset[str], topical: frozenset[str], languages: frozenset[str]):
        self.known, self.topical, self.languages = known, topical, languages
        self.letters = frozenset(c for w in known for c in w if not UNSPACED.match(c))

    def made_up(self, paragraphs: list[str], language: str | None) -> bool:
        """Whether some paragraph is made of words that no language of the corpus has.

        Only where the document's language has a lexicon, and for paragraphs in its letters: of other
        languages and of scripts without spaces the lexicons say nothing, so such texts never count.
        """
        if (language or "") not in self.languages:
            return False
        for paragraph in paragraphs:
            # a word takes four characters with what parts it from the next, so many known words settle it
            if len(self.known.intersection(paragraph.split())) < FILLER_KNOWN * (len(paragraph) + 1) / 4:
                words = WORDS.findall(paragraph)
                if len(words) >= FILLER_WORDS and sum(map(self.known.__contains__, words)) < FILLER_KNOWN * len(words):
                    letters = "".join(words)
                    if sum(map(self.letters.__contains__, letters)) >= COVERED * len(letters):
                        return True
        return False


def lexicons(df: DataFrame, text: str, language: str) -> Lexicon:
    """The :class:`Lexicon` of all texts; what is collected is bounded by the shares above."""
    rows = df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(language), F.lit("")).alias("l"), F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}{3,})"), 1)).alias("w"))
    per = rows.groupBy("l").count()
    total = per.agg(F.sum("count")).collect()[0][0] or 0
    counts = {r["l"]: r["count"] for r in per.where(F.col("count") >= max(LANGUAGE_LEAST, LANGUAGE_SHARE * total)).collect()}
    if not counts:
        return Lexicon(frozenset(), frozenset(), frozenset())
    sizes = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("l"))
    words = rows.where(F.col("l").isin(*counts)).select("l", F.explode("w").alias("word")).groupBy("l", "word").count()
    often = words.withColumn("share", F.col("count") / sizes).where((F.col("count") >= LEAST) & (F.col("share") >= KNOWN_SHARE))
    found = often.groupBy("word").agg(F.max("share").alias("share")).collect()
    return Lexicon(frozenset(r["word"] for r in found), frozenset(r["word"] for r in found if r["share"] >= TOPIC_SHARE), frozenset(counts))


def examine(text: str, lexicon: Lexicon, slug: str | None = None, language: str | None = None) -> tuple[str, str, int, bool] | None:
    """(kind, body, words beside the message, whether title or address and the rest share no term) of a suspicious text, else None."""
    if placeholders(text):
        return "placeholder", "", 0, True
    low = text.lower()
    paragraphs = PARAGRAPHS.split(low)
    told = any(t in low for t in TRIGGERS)
    if not told and len(text) > LONG:
        return ("filler", "", 0, True) if lexicon.made_up(paragraphs, language) else None
    segments = [s for s in SEGMENTS.split(text) if s.strip()]
    title = segments[0] if len(segments) > 1 and "\n" in text and not re.search(r"[.!?。！？]$", segments[0]) and 3 <= len(segments[0].split()) <= TITLE_WORDS else ""
    matches = [next(((k, m) for k, p in (("filler", FILLER), ("notice", NOTICE), ("error", ERROR)) if (m := p.search(s))), (None, None)) if told else (None, None) for s in segments]
    kinds = [(k, s) for (k, _), s in zip(matches, segments)]
    message = [(k, s) for k, s in kinds if k]
    if not message and lexicon.made_up(paragraphs, language):
        return "filler", "", 0, True
    body = [s for k, s in kinds if not k and s is not title]
    rest = sum(map(n_words, body))
    if message:
        rest += sum(n_words(s) - n_words(m.group()) for (k, m), s in zip(matches, segments) if k)
        at = next(i for i, (k, _) in enumerate(matches) if k)
        start = matches[at][1].start()
        if title and at > 0:
            before, after = title, "\n".join(s for s in segments[1:] if s != title)
        else:
            before = "\n".join((*segments[:at], segments[at][:start]))
            after = "\n".join((segments[at][start:], *(s for s in segments[at + 1 :] if s not in before)))  # a page's frame recurs
        return message[0][0], plain(message[0][1]), rest, unlike(before, after, slug, rest)
    terms = terms_of("\n".join(s for _, s in kinds if s is not title))
    mismatch = not (terms_of(title) & terms)
    if 3 <= rest <= REAL_WORDS and not terms & lexicon.topical:
        return "unknown", " / ".join(sorted(plain(s) for s in body)), rest, mismatch
    return None


def find_residue(df: DataFrame, key: str, text: str, host: str, slug: str, language: str) -> DataFrame:
    """(``key``, kind, n_slugs, n_hosts, score): the documents that hold residue instead of content.

    ``kind``: placeholder, filler, error, notice or unknown (a message no pattern knows). A placeholder
    or filler anywhere is a case; filler is told by its phrases, or by words that no language of the
    corpus has (:meth:`Lexicon.made_up`; never for languages or scripts without a lexicon). A message is one if there is hardly any other text and its evidence
    is 4 or more: the pattern (2), hardly any other text (1), the same message under several addresses
    or hosts (1), no term shared by title or address and the rest (1; the words before the message
    stand for a missing title, see :func:`unlike`). An unknown message needs the last three and five addresses. Null, empty and blank texts
    are no cases, nor are texts that mention such things in running text. Repeated keys give a row
    each time; null hosts and addresses are a value of their own. Only the named columns are read.
    """
    own = df.select(F.col(key).cast("long").alias("doc"), F.col(host).cast("string").alias("host"), F.col(slug).cast("string").alias("slug"), F.col(language).cast("string").alias("l"), F.col(text).alias("t"))
    lexicon = lexicons(own, "t", "l")

    def work(batches):
        for batch in batches:
            rows = []
            for doc, h, s, l, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = examine(t, lexicon, s, l) if t and not t.isspace() else None
                if found:
                    rows.append((doc, h, s, *found))
            if rows:
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=EVIDENCE.fieldNames())

    evidence = own.mapInArrow(work, EVIDENCE)
    messages = evidence.where("body <> ''").groupBy("body").agg(F.approx_count_distinct(F.coalesce("slug", F.lit(""))).alias("n_slugs"), F.approx_count_distinct(F.coalesce("host", F.lit(""))).alias("n_hosts"))
    judged = evidence.join(messages, "body", "left").withColumns({"n_slugs": F.coalesce("n_slugs", F.lit(1)), "n_hosts": F.coalesce("n_hosts", F.lit(1))})
    one = lambda c: F.when(c, 1).otherwise(0)
    score = F.when(F.col("kind").isin("placeholder", "filler"), 5).otherwise(
        F.when(F.col("kind") == "unknown", 0).otherwise(2) + one(F.col("rest") <= REAL_WORDS) + one((F.col("n_slugs") >= 3) | (F.col("n_hosts") >= 2)) + one(F.col("mismatch"))
    )
    low = F.col("kind").isin("placeholder", "filler") | (F.col("rest") <= REAL_WORDS)
    case = low & (F.col("score") >= F.when(F.col("kind") == "unknown", 3).otherwise(4)) & ((F.col("kind") != "unknown") | (F.col("n_slugs") >= 5))
    return judged.withColumn("score", score).where(case).select(F.col("doc").alias(key), "kind", "n_slugs", "n_hosts", "score")


def without_residue(df: DataFrame, key: str, text: str, host: str, slug: str, language: str) -> DataFrame:
    """The rows of ``df`` that :func:`find_residue` does not name, with all their columns; null keys stay."""
    return df.join(find_residue(df, key, text, host, slug, language).select(key).distinct(), key, "left_anti")
