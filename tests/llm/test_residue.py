import pytest

from lodestone.llm.residue import find_residue, n_words, placeholders, without_residue

REAL = "The supernatant was assayed for residual protein, and the bound amount was calculated by difference."


@pytest.mark.parametrize("text", ["{{ name }}", "${carrier}", "#{ph_value}", "%(doi)s", "«abstract»", "[[authors]]", "{yield_pct}", "@@DOI@@", "__SAMPLE_ID__", "XXX_ABSTRACT_XXX", "[TODO: buffer]", "<INSERT ABSTRACT HERE>", "<carrier goes here>", "{% buffer %}", "<%= doi %>", "[enter journal]"])
def test_placeholders(text):
    assert placeholders(f"Kept at {text} for an hour.")


@pytest.mark.parametrize("text", ["set {A, B, C} was left out", "$K_m$ was fitted", "below <LOD% were set to zero", "planes {110} and {111}", "[M+2H]", "[to be confirmed]", "see [12]", "x < y and y > z", "50 % (w/w)"])
def test_what_is_no_placeholder(text):
    assert not placeholders(text)


def test_cases(spark):
    rows = [
        (1, REAL * 3, "a", "s1"), (2, "You need to enable JavaScript to view this article.", "a", "s2"), (3, "Menu\nSign in\n404 Not Found\nPlease return to the start page.", "b", "s3"),
        (4, "The vendor page returned a 404 error, so the certificate was requested by post. " + REAL, "b", "s4"), (5, "Curve fitting scripts are listed, and JavaScript was used for the plots only. " + REAL, "b", "s5"),
        (6, None, "a", "s6"), (7, "", None, None), (8, "   ", "a", "s7"), (9, "Lorem ipsum dolor sit amet", None, None), (10, REAL + " It held {{ value }} then.", "a", "s8"),
        (11, "Access to the inner pores was denied to molecules above 4 nm. " + REAL, "a", "s9"), (12, "页面不存在或已被删除", "a", "s9"), (13, REAL * 200, "a", "s1"), (None, "500 Internal Server Error", "c", "s"),
    ]
    df = spark.createDataFrame([(*r, "en") for r in rows], "k bigint, t string, kind string, slug string, lang string")
    assert {r.k for r in find_residue(df, "k", "t", "kind", "slug", "lang").collect()} == {2, 3, 9, 10, 12, None}
    assert {r.k for r in without_residue(df, "k", "t", "kind", "slug", "lang").collect()} >= {1, 4, 5, 6, 7, 8, 11, 13}
    assert find_residue(df.limit(0), "k", "t", "kind", "slug", "lang").count() == 0


def test_a_pattern_alone_is_no_case(spark):
    rows = [
        (1, "The supplier answered with 503 Service Unavailable, so the certificate was requested by post.", "a", "s1"),
        (2, "Retrieval of the records\nThe records were read twice since the archive said access denied at first.", "a", "s2"),
        (3, "Retrieval of the records\nAccess denied.\nPlease write to our help desk.", "a", "s3"),
        (4, "Page not found", "a", "archive-page-notes.pdf"), (5, "Page not found", "a", "lipase-beads.pdf"),
        (6, "固定化脂肪酶在有机溶剂中的活性测定方法如下，先将载体与缓冲液混合，再加入酶液并搅拌两小时，离心后测定上清液中的蛋白质含量，数据库曾提示访问被拒绝，因此改用纸质记录，所有批次均重复三次并取平均值，误差以标准差表示。", "a", "s6"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "k bigint, t string, host string, slug string, lang string")
    assert {r.k for r in find_residue(df, "k", "t", "host", "slug", "lang").collect()} == {3, 5}
    assert n_words("酶的固定") == 2 and n_words("of lipase") == 1


RUSSIAN = "Фермент закрепляли на носителе в течение двух часов, затем образец промывали буферным раствором и хранили в холодильнике до измерения активности."
ARABIC = "تم تثبيت الإنزيم على الحامل لمدة ساعتين ثم غسلت العينة بمحلول منظم وحفظت في الثلاجة حتى قياس النشاط في اليوم التالي من التجربة."
POLISH = "Enzym unieruchomiono na nośniku przez dwie godziny, następnie próbkę przemyto buforem i przechowywano w lodówce aż do pomiaru aktywności."
MADE_UP = "Trea sutru vechae nobre cidra glotrio natredri taefiotzae nudaeca kioki ropeabra vaenidre raeli pavea briomu taecho feasio."


def test_texts_in_rare_languages_are_no_filler(spark):
    rows = [(i, REAL, "en") for i in range(60)] + [(100, RUSSIAN, "ru"), (101, ARABIC, "ar"), (102, RUSSIAN, "en"), (103, ARABIC, None), (104, POLISH, "pl"), (105, MADE_UP, "en"), (106, REAL + "\n\n" + MADE_UP, "en"), (107, MADE_UP, "xx"), (108, MADE_UP, None)]
    df = spark.createDataFrame([(k, t, "h", f"s{k}", lang) for k, t, lang in rows], "k bigint, t string, host string, slug string, lang string")
    assert {(r.k, r.kind) for r in find_residue(df, "k", "t", "host", "slug", "lang").collect()} == {(105, "filler"), (106, "filler")}
    assert {100, 101, 102, 103, 104} <= {r.k for r in without_residue(df, "k", "t", "host", "slug", "lang").collect()}


def test_evidence_of_hosts_and_addresses_decides(spark):
    """The same message, with a title it has a term in common with: a case under many addresses, none under one."""
    message = "Access to supported enzymes\nAccess denied for enzymes archive"
    one, many = [(1, message, "a", "s1")], [(i, message, "ab"[i % 2], f"s{i}") for i in range(6)]
    kind = "k bigint, t string, host string, slug string, lang string"
    found = lambda rows: {r.k for r in find_residue(spark.createDataFrame([(*r, "en") for r in rows], kind), "k", "t", "host", "slug", "lang").collect()}
    assert found(one) == set() and found(many) == set(range(6))
    unknown = [(i, "Bin gathered elsewhere tonight", "ab"[i % 2], f"s{i}") for i in range(6)]
    assert found(unknown[:3]) == set() and found(unknown) == set(range(6))
