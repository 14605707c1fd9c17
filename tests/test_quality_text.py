"""Field checks (V1-V3) and scalar text functions."""
from pyspark.sql import functions as F

from docket.functions.text import iso_cleanup, parse_list_literal, py_tokens, tfidf_tokens
from docket.operators import quality


def test_field_rule_boundaries(spark):
    rows = [("", "a", "@"), ("a", "ab", "a@b"), ("a" * 20, "a" * 99, "a@" + "b" * 317),
            ("a" * 21, "a" * 100, "a@" + "b" * 318), ("ok\n", "x", "ab"), ("b@d", None, None)]
    df = spark.createDataFrame(rows, "username string, name string, email string")
    got = [(r.username_ok, r.name_ok, r.email_ok) for r in quality.check_accounts(df).collect()]
    assert got == [(False, False, False), (True, True, True), (True, True, True),
                   (False, False, False), (True, False, False), (False, None, None)]


def test_python_whitespace_tokens(spark):
    text = "a b\tc  d e\n"
    got = spark.createDataFrame([(text,)], "t string").select(py_tokens(F.col("t"))).first()[0]
    assert got == text.split()


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("2024-06-21T10:11:12.123+00:00", "['a.xlsx', 'b c.xlsx']", "Ab cd_e1 x É9")],
                               "iso string, lst string, t string")
    r = df.select(iso_cleanup(F.col("iso")).alias("i"), parse_list_literal(F.col("lst")).alias("l"),
                  tfidf_tokens(F.col("t")).alias("k")).first()
    assert r.i == "2024-06-21 10:11:12"
    assert r.l == ["a.xlsx", "b c.xlsx"]
    assert r.k == ["ab", "cd_e1", "é9"]


def test_words_only(spark):
    from docket.functions.text import words_only
    rows = [("The  Judge, the JUDGE; orders\u00a0\"payment\" (now) x2 e-mail don't Código", "judge judge orders payment código"),
            ("", ""), (None, None), ("12 the of !!", "")]
    df = spark.createDataFrame(rows, "t string, e string").withColumn("w", words_only(F.col("t")))
    assert [(r.w, r.e) for r in df.collect() if r.w != r.e] == []


def test_pair_cosine_of_normalised_texts(spark):
    from docket.functions.text import words_only
    from docket.operators.similarity import tfidf_cosine
    df = spark.createDataFrame([(1, "The payment of the fee", "PAYMENT: a fee!"), (2, "the of", "the of")],
                               "i int, a string, b string")
    got = {r.i: r.cosine for r in tfidf_cosine(df, ["i"], "a", "b", normalize=words_only).collect()}
    assert abs(got[1] - 1) < 1e-12 and got[2] is None


def test_manifests_without_a_list_are_rejected(spark):
    from docket.sources import landing
    rows = [("a", "['x', 'y']"), ("b", None), ("c", "['x'"), ("d", "{'x': 1}"), ("e", "('p', None)"), ("f", "['it\\'s']"),
            ("g", "[]"), ("h", "os.system('x')")]
    df = spark.createDataFrame(rows, "name string, list_files_compare string")
    assert sorted((r.name, r.file_name or "") for r in landing.manifest_files(df).collect()) == [
        ("a", "x"), ("a", "y"), ("e", ""), ("e", "p"), ("f", "it's")]
    assert sorted((r.name, r.reason) for r in landing.manifest_rejects(df).collect()) == [
        ("b", "no_list"), ("c", "bad_list"), ("d", "bad_list"), ("h", "bad_list")]
