"""Repair of text from scanned pages into continuous paragraphs.

Page furniture (running headers, footers, page numbers) is taken out: by form, and by recurrence over
the pages of a document. Words cut at line ends are joined, and misread words are corrected by a noisy
channel: candidates within two character confusions, weighed by confusion probability times the
corpus's bigram likelihood and decoded by Viterbi over each line. How likely each confusion is is
estimated from the corpus by expectation and maximisation.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of all counted words that a word, a word pair and a hyphenated pair need to be in the model; each bounds the model's size by its reciprocal. LEAST: counts needed besides.
WORD_SHARE, PAIR_SHARE, HYPHEN_SHARE, LEAST = 3e-6, 1e-5, 1e-6, 3
#: How often a character is misread in a scanned text, over all confusions; each one's own probability is estimated relative to it, within SPREAD times.
MISREAD, SPREAD = 0.004, 20.0
#: A running line stands on so many pages of its document, and on this share of those that have several lines: so a document has at most (lines a page / share) of them.
RUNNING_PAGES, RUNNING_SHARE = 3, 0.2
#: A known word is doubted if a candidate is so many times more frequent.
DOUBT = 30.0

# How characters are misread: what is seen -> what may stand there.
SEEN: dict[str, list[str]] = {
    "ii": ["u"], "vv": ["w"], "rn": ["m"], "nn": ["m"], "in": ["m"], "m": ["rn", "in", "nn", "ni"], "ri": ["n"], "n": ["ri", "u"], "cl": ["d"], "d": ["cl"], "li": ["h"], "w": ["vv"], "u": ["ii", "n"],
    "l": ["i", "t"], "i": ["l", "j"], "1": ["l", "i"], "|": ["l", "i"], "!": ["l", "i"], "f": ["t"], "t": ["f", "l"], "b": ["h"], "h": ["b", "li"], "c": ["e", "o"], "e": ["c", "o"], "o": ["c", "e", "a"], "a": ["o"], "q": ["g"], "g": ["q"], "9": ["g"],
    "0": ["o"], "5": ["s"], "6": ["b"], "8": ["b"], "3": ["e"], "4": ["a"], "7": ["t"], "2": ["z"], "y": ["v"], "v": ["y"], "s": ["a"], "j": ["i"],
}
HYPHENS = "-‐‑¬\xad"
TOKEN = re.compile(r"[^\W_]+(?:\|+[^\W_]+)*\|?|\|+[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
CUT = re.compile(rf"([^\W_|]+(?:\|[^\W_|]+)*)[{HYPHENS}][^\S\n]*$")
#: Numbers count as one word in the model; tokens with several groups of digits or a long one are codes.
NUMBERS, NUMBER = re.compile(r"\d+(?:[.,]\d+)?"), "0"
MANY_DIGITS = re.compile(r"\d\d|\d.*\d.*\d")
HYPHENED = re.compile(r"\b([^\W\d_]{1,40})-(?=([^\W\d_]{1,40}))")
#: What a running line ends with, or has at its start; a quick test before :data:`RUNNING`.
EDGE = re.compile(r"[\dOolI|]")
BULLET = re.compile(r"\s*(?:[-•*–]\s|\(?(?:\d{1,3}|[a-zA-Z])[.)]\s)")
# Forms of page numbers and of running lines (case and misread digits aside).
NUMERAL = r"[\dOolI|]{1,4}"
PAGE_NUMBER = re.compile(rf"(?:[-–—]\s*{NUMERAL}\s*[-–—]|\[{NUMERAL}\]|{NUMERAL}|p(?:p|g)?\.?\s*{NUMERAL}|p?[pP]a[gq][ec]\s+{NUMERAL}(?:\s+[0o]f\s+{NUMERAL})?|[ivxlcIVXLC]{{1,7}})")
RUNNING = re.compile(
    rf"[^.!?]{{3,90}}\s/\s[A-Z]{{1,3}}[\dOolI|]{{2,8}}|{NUMERAL}(?:\s{{2,}}|\s*\|\s*)[^\W\d_][^.!?]{{4,90}}|[^\W\d_][^.!?]{{4,90}}(?:\s{{3,}}|\s\|\s){NUMERAL}|\w{{6,12}} [A-Z]{{1,3}}[\dOolI|]{{2,8}}, \w{{6,10}} {NUMERAL}"
    rf"|[A-Z][^.!?]{{5,80}}\s{NUMERAL}\s\([12l|I][\dOolI|]{{3}}\)\s{NUMERAL}\s*[-–—]\s*{NUMERAL}|[A-Z][^.!?]{{5,80}},\s+V\w{{2}}\.?\s*{NUMERAL}(?:,\s+N\w\.?\s*{NUMERAL})?|[A-Z][^.!?]{{5,80}}\s·\s\w+\s{NUMERAL}"
)


def cut_word(line: str) -> re.Match | None:
    """The match of a word that a hyphen cuts at the end of ``line``."""
    end = line.rstrip()
    return CUT.search(line, max(0, len(end) - 60)) if end and end[-1] in HYPHENS else None


def is_furniture(line: str) -> bool:
    """Whether a line has the form of a page number, a running header or a running footer."""
    text = line.strip()
    if not text or len(text) > 120 or text[-1] in ".;,":
        return False
    if len(text) < 20 and PAGE_NUMBER.fullmatch(text):
        return True
    if (EDGE.match(text) or EDGE.search(text, max(0, len(text) - 2)) or text[-1] == "I") and RUNNING.fullmatch(text):
        return True
    if text[:4] != text[:4].upper():
        return False
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= 10 and " " in text and sum(c.isupper() for c in letters) >= 0.9 * len(letters) and text[-1] not in ".!?;"


def signature(line: str) -> str:
    """A line as it recurs from page to page: digits and case aside."""
    return re.sub(r"[0-9]+", "#", line.strip(" ")).lower()


def without_furniture(text: str, pairs: dict | None = None, running: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """(lines that belong to the text, lines taken out). A text of one line is kept as it is."""
    lines = text.split("\n")
    if len(lines) == 1:
        return lines, []
    out = [is_furniture(line) for line in lines]
    if pairs is not None:
        body = [i for i, gone in enumerate(out) if not gone and lines[i].strip()]
        for before, at, after in zip(body, body[1:], body[2:]):
            if _interrupts(lines[before], lines[at], lines[after], pairs, signature(lines[at]) in running):
                out[at] = True
    if all(out[i] or not lines[i].strip() for i in range(len(lines))):
        return lines, []
    return [line for line, gone in zip(lines, out) if not gone], [line.strip() for line, gone in zip(lines, out) if gone]


def _interrupts(before: str, line: str, after: str, pairs: dict, recurs: bool = False) -> bool:
    """Whether ``line``, which recurs on the document's pages or whose own words don't read as text, stands between two lines that continue each other."""
    if re.search(r"[.!?:;]\s*$", before) or re.search(rf"[{HYPHENS}.!?:;,]\s*$", line) or cut_word(before) or BULLET.match(line) or not re.match(r"\s*[A-Z\d]", line) or not after.strip()[:1].islower():
        return False
    words = [TOKEN.findall(NUMBERS.sub(NUMBER, x.lower())) for x in (before, line, after)]
    inside = list(zip(words[1], words[1][1:]))
    if not all(words) or not recurs and sum(pair in pairs for pair in inside) > 0.2 * len(inside):
        return False
    return (words[0][-1], words[2][0]) in pairs and (words[0][-1], words[1][0]) not in pairs and (words[1][-1], words[2][0]) not in pairs


def joined_lines(lines: list[str]) -> list[list[str]]:
    """Paragraphs as lists of lines; a blank line ends one, unless it follows a cut word."""
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if not line.strip():
            if paragraphs[-1] and not cut_word(paragraphs[-1][-1]):
                paragraphs.append([])
        else:
            if paragraphs[-1] and BULLET.match(line) and not cut_word(paragraphs[-1][-1]):
                paragraphs.append([])
            paragraphs[-1].append(line)
    return [p for p in paragraphs if p]


class Model:
    """Word, pair and hyphenation counts of a corpus, and the decisions that follow from them."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], hyphens: dict[tuple[str, str], int], prices: dict[tuple[str, str], float] | None = None):
        self.words, self.pairs, self.hyphens = words, pairs, hyphens
        #: Log of the probability that what is seen stands for what is true.
        self.prices = prices or {(seen, true): math.log(MISREAD) for seen, trues in SEEN.items() for true in trues}
        self.total = sum(words.values()) or 1
        self.options: dict[str, list[tuple[str, float]]] = {}
        self.clean: set[str] = set()

    def candidates(self, token: str) -> list[tuple[str, float]]:
        """(word, log of the confusion probability) of what ``token`` may stand for, itself included; only itself if beyond doubt."""
        known = self.options.get(token)
        if known is None:
            if MANY_DIGITS.search(token):
                return [(token, 0.0)]
            if len(self.options) > 300_000:
                self.options.clear()
                self.clean.clear()
            known = self.options[token] = self._candidates(token)
            if len(known) == 1:
                self.clean.add(token)
        return known

    def _candidates(self, token: str) -> list[tuple[str, float]]:
        itself = [(token, math.log(0.97))]
        letters = sum(c.isalpha() for c in token)
        if letters < 2 or len(token) < 3 and token.isalpha() or len(token) > 40 or sum(c.isdigit() for c in token) > max(1, letters // 4):
            return itself
        count = self.words.get(token, 0)
        plain = unicodedata.normalize("NFKD", token)
        plain = "".join(c for c in plain if not unicodedata.combining(c)) if not plain.isascii() else plain
        found: dict[str, float] = {}
        self.edits: dict[str, tuple] = {}
        if plain != token and self.words.get(plain, 0) > count:
            found[plain] = math.log(0.02)
        steps = {plain: (0.0 if plain == token else math.log(0.02), ())}
        for step in range(2):
            made: dict[str, tuple[float, tuple]] = {}
            for form, (cost, edits) in steps.items():
                for i in range(len(form)):
                    for width in (1, 2):
                        seen = form[i : i + width]
                        for true in SEEN.get(seen, ()) if i + width <= len(form) else ():
                            new = form[:i] + true + form[i + width :]
                            price = cost + self.prices[seen, true]
                            if new not in found and new not in steps and price > made.get(new, (-99.0,))[0]:
                                made[new] = (price, (*edits, (seen, true)))
            for new, (price, edits) in made.items():
                if self.words.get(new, 0) > DOUBT * count and new.isalpha() and (step == 0 or len(new) >= 6 or not token.isalpha()):
                    found[new] = max(found.get(new, -99.0), price)
                    self.edits[new] = edits
            if found or len(token) > 24:
                break
            steps = made
        if not found:
            return itself
        return itself + sorted(found.items(), key=lambda x: -x[1] - math.log(self.words[x[0]]))[:8]

    def expected(self, token: str, n: int, into: Counter) -> None:
        """Adds the confusions behind ``n`` occurrences of ``token``, in proportion to how likely each candidate is."""
        options = self._candidates(token)
        if len(options) > 1:
            weights = [math.exp(cost + self.likelihood(None, word)) for word, cost in options]
            for (word, _), weight in zip(options[1:], weights[1:]):
                for edit in self.edits.get(word, ()):
                    into[edit] += n * weight / sum(weights)

    def estimated(self, confusions: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
        """The prices that expected numbers of ``confusions`` give: how often what is true was read so, relative to all confusions."""
        there = {true: sum(n * word.count(true) for word, n in self.words.items() if true in word) for true in {t for _, t in self.prices}}
        whole, places = sum(confusions.values()), sum(there[true] for _, true in self.prices)
        if not whole or not places:
            return self.prices
        mean = whole / places
        rate = lambda edit: (confusions.get(edit, 0.0) + 1.0) / (there[edit[1]] + 1.0 / mean) / mean
        return {edit: math.log(MISREAD * min(max(rate(edit), 1 / SPREAD), SPREAD)) for edit in self.prices}

    def likelihood(self, before: str | None, word: str) -> float:
        """Log of the interpolated bigram probability; unknown words get the mass of half a count, less the longer they are."""
        single = self.words.get(word, 0)
        if not single:
            return math.log(0.05 / self.total) - 1.0 * (not word.isalpha())
        pair = self.pairs.get((before, word), 0) / max(self.words.get(before, 0), 1) if before is not None else 0.0
        return math.log(0.7 * min(pair, 1.0) + 0.3 * single / self.total)

    def decode(self, tokens: list[str]) -> list[str]:
        """The most likely words behind the lower-case ``tokens`` of a line (Viterbi)."""
        options = [[(NUMBER, 0.0)] if t.isdigit() else self.candidates(t) for t in tokens]
        if all(len(o) == 1 for o in options):
            return tokens
        states, back = [(None, 0.0)], []
        for choice in options:
            if len(choice) == len(states) == 1:  # every path goes here, so earlier scores no longer matter
                states = [(choice[0][0], 0.0)]
                back.append([0])
                continue
            scored, origin = [], []
            for word, cost in choice:
                before, (name, score) = max(enumerate(states), key=lambda s: s[1][1] + self.likelihood(s[1][0], word))
                scored.append((word, score + self.likelihood(name, word) + cost))
                origin.append(before)
            states = scored
            back.append(origin)
        at = max(range(len(states)), key=lambda i: states[i][1])
        out = []
        for token, choice, origin in zip(reversed(tokens), reversed(options), reversed(back)):
            out.append(choice[at][0] if len(choice) > 1 else token)
            at = origin[at]
        return out[::-1]

    def knows(self, word: str) -> int:
        """How often ``word`` or what it stands for occurs."""
        return max(self.words.get(w, 0) for w, _ in self.candidates(word))

    def bridge(self, left: str, right: str, sign: str) -> str:
        """What stands between the parts of a word cut at a line's end: nothing, or a hyphen."""
        a, b = left.lower(), right.lower()
        if not (a[-1].isalpha() or a[-1] in "|015") or not b[0].isalpha() and b[0] not in "|015" or a.isdigit() or b.isdigit():
            return "-"
        if left.isupper() and len(left) > 1 and right[0].isdigit():
            return "-"
        whole, apart = self.knows(a + b), self.hyphens.get((a, b), 0)
        if apart > whole:
            return "-"
        if whole or sign in "¬\xad":
            return ""
        both = self.words.get(a, 0) and self.words.get(b, 0) and len(a) > 3 and len(b) > 3
        return "-" if both or right[0].isupper() else ""

    def repair(self, text: str, running: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
        """(repaired text, lines taken out)."""
        lines, gone = without_furniture(text, self.pairs, running)
        paragraphs = []
        for paragraph in joined_lines(lines):
            whole = paragraph[0].strip()
            for line in paragraph[1:]:
                cut, line = cut_word(whole), line.strip()
                first = TOKEN.match(line)
                if cut and first:
                    sign = whole[cut.end(1)]
                    whole = whole[: cut.end(1)] + self.bridge(cut.group(1), first.group(), sign) + line
                else:
                    whole += " " + line
            paragraphs.append(self._corrected(re.sub(r"[^\S\n]+", " ", whole)))
        return ("\n" if BULLET.match(text) else "\n\n").join(paragraphs), gone

    def _corrected(self, line: str) -> str:
        unseen = set(TOKEN.findall(line.lower())) - self.clean
        if all(len(self.candidates(token)) == 1 for token in unseen):
            return line
        spans = list(TOKEN.finditer(line))
        tokens = [m.group().lower() for m in spans]
        words = self.decode(tokens)
        if words == tokens:
            return line
        out, end = [], 0
        for match, token, word in zip(spans, tokens, words):
            if word == token:
                continue
            seen = match.group()
            letters = [c for c in seen if c.isalpha()]
            out += (line[end : match.start()], word.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else word.capitalize() if letters[0].isupper() and seen[0] == letters[0] else word)
            end = match.end()
        return "".join(out) + line[end:]


def counted(text: str, words: Counter, pairs: Counter, hyphens: Counter) -> None:
    """Adds the words, pairs and hyphenated pairs that stand inside the lines of ``text``."""
    lines, _ = without_furniture(text)
    skip = False
    for line in lines:
        line = line.lower()
        tokens = TOKEN.findall(NUMBERS.sub(NUMBER, line))
        if skip:
            tokens = tokens[1:]
        skip = cut_word(line) is not None
        if skip:
            tokens = tokens[:-1]
        words.update(tokens)
        pairs.update(zip(tokens, tokens[1:]))
        if "-" in line:
            hyphens.update(HYPHENED.findall(line))


def learn(df: DataFrame, text: str) -> Model:
    """The model of all texts. What is collected is bounded by the shares above."""
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])

    def work(batches):
        for batch in batches:
            words, pairs, hyphens = Counter(), Counter(), Counter()
            for value in batch.column(0).to_pylist():
                if value:
                    counted(value, words, pairs, hyphens)
            rows = [("w", w, "", n) for w, n in words.items()] + [("p", a, b, n) for (a, b), n in pairs.items()] + [("h", a, b, n) for (a, b), n in hyphens.items()] + [("t", "", "", words.total())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=kind.fieldNames())

    from lodestone.session import cut_lineage

    counts = cut_lineage(df.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(work, kind).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    total = counts.where("kind = 't'").agg(F.sum("n")).collect()[0][0] or 0
    share = F.when(F.col("kind") == "w", WORD_SHARE).when(F.col("kind") == "p", PAIR_SHARE).otherwise(HYPHEN_SHARE)
    often = counts.where((F.col("kind") != "t") & (F.col("n") >= F.greatest(F.lit(float(LEAST)), share * total))).toArrow().to_pylist()
    model = Model({r["a"]: r["n"] for r in often if r["kind"] == "w"}, {(r["a"], r["b"]): r["n"] for r in often if r["kind"] == "p"}, {(r["a"], r["b"]): r["n"] for r in often if r["kind"] == "h"})
    shared = df.sparkSession.sparkContext.broadcast((model.words, model.prices))

    def expectation(batches):
        """The confusions behind all words, the rare ones too; words without pairs."""
        known, prices = shared.value
        own, into = Model(known, {}, {}, prices), Counter()
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own.expected(word, n, into)
        if into:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in into]) for i in (0, 1)] + [pa.array(list(into.values()), pa.float64())], names=["seen", "true", "n"])

    doubtful = counts.where((F.col("kind") == "w") & (F.length("a") > 2) & ~F.col("a").rlike(r"[0-9]{2}|[0-9].*[0-9].*[0-9]")).select("a", "n")
    found = doubtful.mapInArrow(expectation, "seen string, true string, n double").groupBy("seen", "true").agg(F.sum("n").alias("n")).collect()
    model.prices = model.estimated({(r["seen"], r["true"]): r["n"] for r in found})
    return model


def running_lines(df: DataFrame, text: str, document: str, page: str) -> DataFrame:
    """(document, running): the signatures of the lines that recur over the pages of each document (:data:`RUNNING_PAGES`, :data:`RUNNING_SHARE`).

    Only lines inside texts of several lines count that begin like a title and don't end like a sentence.
    """
    several = df.where(F.contains(F.col(text), F.lit("\n")) & F.col(document).isNotNull() & F.col(page).isNotNull()).select(F.col(document).alias("d"), F.col(page).alias("p"), F.split(text, "\n").alias("lines"))
    lines = several.select("d", "p", F.explode("lines").alias("line")).where(F.col("line").rlike(r"^ *[A-Z0-9]") & ~F.col("line").rlike(r"[.!?:;,-] *$"))
    seen = lines.groupBy("d", F.lower(F.regexp_replace(F.trim("line"), "[0-9]+", "#")).alias("s")).agg(F.count_distinct("p").alias("n")).where(F.col("n") >= RUNNING_PAGES)
    pages = several.groupBy("d").agg(F.count_distinct("p").alias("pages"))
    return seen.join(pages, "d").where(F.col("n") >= RUNNING_SHARE * F.col("pages")).groupBy(F.col("d").alias("document")).agg(F.collect_set("s").alias("running"))


REPAIRED = [T.StructField("repaired", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("new_words", T.ArrayType(T.StringType()))]


def repair_scans(df: DataFrame, keys: list[str], text: str, document: str | None = None, page: str | None = None, model: Model | None = None) -> DataFrame:
    """(``keys``, repaired, lines, new_words) of every row.

    ``lines``: the distinct page furniture taken out, as stored and trimmed; ``new_words``: the distinct
    words of four letters or more of the repaired text that the stored one has not. Null stays null
    with empty lists, empty and blank texts become empty; a text that is nothing but furniture is
    kept. Repeated rows give repeated results. With ``document`` and ``page``, lines that recur over
    the pages of a document are furniture where they interrupt a sentence. ``model`` defaults to one of
    all texts in ``df``; it is broadcast, its size is bounded by the shares above.
    """
    model = model or learn(df, text)
    shared = df.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.hyphens, model.prices))
    names = [f"k{i}" for i in range(len(keys))]
    own = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *([F.col(document).alias("document")] if document and page else []), F.col(text).alias("t"))
    if document and page:
        own = own.join(running_lines(df, text, document, page), "document", "left").select(*names, "t", "running")
    else:
        own = own.withColumn("running", F.lit(None).cast("array<string>"))

    def work(batches):
        own_model = Model(*shared.value)
        for batch in batches:
            repaired, gone, new = [], [], []
            for value, running in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if value is None:
                    repaired.append(None)
                    gone.append([])
                    new.append([])
                    continue
                fixed, lines = own_model.repair(value, frozenset(running or ()))
                repaired.append(fixed)
                gone.append(sorted(set(lines)))
                new.append(sorted({w for w in LETTERS.findall(fixed.lower()) if len(w) >= 4} - set(LETTERS.findall(value.lower()))) if fixed != value else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(repaired, pa.string()), pa.array(gone, pa.list_(pa.string())), pa.array(new, pa.list_(pa.string()))], names=[*names, "repaired", "lines", "new_words"])

    schema = T.StructType([T.StructField(n, own.schema[n].dataType) for n in names] + REPAIRED)
    return own.mapInArrow(work, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "repaired", "lines", "new_words")
