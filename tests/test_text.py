import unicodedata

from pyspark.sql import functions as F

from tessera.functions import fold, stem, stopwords, text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_fold_matches_nfkd_on_latin(spark):
    s = "Ação É Ü ñ ç ß Œ æ ĳ ¼ naïve façade Ø"
    expected = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    assert one(spark, fold.fold_ascii, s) == expected
    assert "ss" not in one(spark, fold.fold_ascii, "Straße")      # ß is dropped, not expanded


def test_fold_exact_udf(spark):
    s = "Ελληνικά café"
    assert one(spark, fold.fold_exact, s) == unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_tokens_stopwords_length(spark):
    sw = ["para", "como"]
    df = spark.createDataFrame([("Recurso, para RECURSO como a Petição-inicial 42 de",)], "t string")
    out = df.select(tx.processed_tokens("t", sw, 3).alias("o")).first()["o"]
    assert out == ["recurso", "recurso", "peticao", "inicial"]      # order and repeats kept


def test_word_count_and_open_band(spark):
    rows = [(" ".join(["w"] * n),) for n in (399, 400, 401, 9999, 10000, 10001)]
    df = spark.createDataFrame(rows, "t string").select(tx.word_count("t").alias("n"))
    n = [r.n for r in df.collect()]
    assert n == [399, 400, 401, 9999, 10000, 10001]
    inband = [x for x in n if 400 < x < 10000]
    assert inband == [401, 9999]                                      # Q18: 400 and 10000 are in no band


def test_html_to_text(spark):
    html = ('<html><head><style>p{x:1}</style><script>var t="</p>";f();</script></head>'
            '<body><!-- ad --><p>Olá&nbsp;mundo</p>\n<div>a &amp; b &lt;c&gt;</div></body></html>')
    assert one(spark, tx.html_to_text, html) == "Olá mundo a & b <c>"


def test_clean_for_embeddings_order(spark):
    s = "Veja http://x.com/a1 e mail a1@b.com {nota} – fim…"
    out = one(spark, tx.clean_for_embeddings, s)
    assert "URL" in out and "EMAIL" in out
    assert "{" not in out and "nota" not in out
    assert "1" not in out                      # digits zeroed before URL / e-mail matching


def test_case_number(spark):
    df = spark.createDataFrame([(123, 4, 2019, 5, 1, 27)], "a int, b int, c int, d int, e int, f int")
    out = df.select(tx.case_number("a", "b", "c", "d", "e", "f").alias("o")).first()["o"]
    assert out == "0000123-04.2019.5.01.0027"


def test_stem_rules(spark):
    df = spark.createDataFrame([("trabalhadores",), ("rapidamente",), ("casa",)], "token string")
    out = {r.token: r.stem for r in stem.stem_column(df, "token").collect()}
    assert "rapidamente".startswith(out["rapidamente"]) and not out["rapidamente"].endswith("mente")
    assert len(out["trabalhadores"]) < len("trabalhadores")


def test_spark_stopword_list_matches_jvm(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(stopwords.spark_default("portuguese")) == StopWordsRemover.loadDefaultStopWords("portuguese")


# -- golden values from the standard library, not from the package's own tables ------------------------------------------
def test_fold_equals_nfkd_for_every_character(spark):
    import sys
    import unicodedata
    chars = [chr(c) for c in range(0x20, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [("x".join(chars[i:i + 700]),) for i in range(0, len(chars), 700)] + [("fim…recurso ﬁm № ế Ａ ½",)]
    for r in spark.createDataFrame(rows, "t string").select("t", fold.fold_ascii("t").alias("f")).collect():
        assert r.f == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()


def test_character_references_equal_the_standard_library(spark):
    import html
    from html.entities import html5

    from tessera.functions.entities import decode_references, sql_decode_references
    texts = ["peti&ccedil;&atilde;o n&uacute;mero &#225; &#xE1; &amp;lt; a&b &notit; &eacute, &copy2 &nosuch; & &; &#; &#x; &&amp;&#38;lt;",
             "&#0;&#13;&#128;&#150;&#x9f;&#55296;&#x110000;&#99999999999999;&#xFDD0;&#65534;&#11;&#x1F600; 100%&hellip;"]
    texts += [f"<{a}&{n} &{n};x" for a, n in enumerate(sorted(html5)) for n in [n.rstrip(";")]]
    texts = [t for t in texts if "&#;" not in t] + ["&# 5", "x&"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", decode_references(df.t).alias("d")).collect():
        assert r.d == html.unescape(r.t), r.t
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE x (t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?)", [[t] for t in texts[:60]])
    for t, d in con.execute(f"SELECT t, {sql_decode_references('t')} FROM x").fetchall():
        assert d == html.unescape(t), t


def test_clean_for_embeddings_golden(spark):
    cases = {"Olá MUNDO…": "olá mundo", " {a}b{c}  x\n": "x", "\n a – b \n": "a - b", "12 d'água 'x' “y”": "00 d'água x y",
             "<p>um</p> dois": "um dois", "fim.. aí": "fim . aí", "a;;, b": "a ; b", "e -mail": "e - mail",
             "x (nota) fim.": "x ( nota ) fim .", "http://a.b/1 c@d.e": "URL EMAIL", "": "", "  ": ""}
    for t, want in cases.items():
        assert one(spark, tx.clean_for_embeddings, t) == want, t
