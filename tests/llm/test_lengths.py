"""Values and items of any length: no bound on a secret, an address or a digest, none on a test item."""

from stratalens.llm import decontam, pii


def _changed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [f.value for f in r.found]) for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_long_secrets_addresses_and_digests(spark):
    secret, local, digest = "aB3_" * 75, "first.last9" * 8, "0123456789abcdef" * 8
    long = "x1Y" * 40_000
    got = _changed(spark, f"token={secret} end", f"to {local}@mail.example.com.", f"sum {digest}!", f"api_key: {long}", f"token={secret[:200]}", f"again token={secret} end", f"a@{'b.' * 12}example.com")
    for (text, found), value in zip(got, [secret, f"{local}@mail.example.com", digest, long, secret[:200], secret], strict=False):
        assert found == [value] and value not in text and value[:16] not in text and value[-16:-12] != "" and len(text) > len(value)
    assert got[0][0] in got[5][0].replace("again ", "") and len(got[0][0]) == len(f"token={secret} end")
    assert got[6][1] == [f"a@{'b.' * 12}example.com"]


def test_runs_that_are_no_values_cost_no_squares(spark):
    texts = ["a" * 300_000, "1-" * 100_000 + "x", "token=" + "a" * 300_000, "._" * 100_000, "0" * 300_000 + "g", "secret=" + "a1b." * 2 + "." * 100_000]
    got = _changed(spark, *texts)
    assert [t for t, _ in got[:5]] == texts[:5]


def test_the_budget_grows_with_the_item(spark):
    assert [decontam.budget(m, 5) for m in (5, 19, 20, 39, 40, 59, 60, 400)] == [0, 0, 1, 1, 2, 2, 3, 20]
    short, longer = "which river is the longest in asia ?", "which river is the longest one in asia ?"
    swap = lambda t: t.replace("river", "rivr", 1)
    docs = spark.createDataFrame([(1, "x " + swap(short) + " y"), (2, swap(longer)), (3, "which rivr is teh longst in asia ?"), (4, "tiny item"), (5, "a tiny itemised")], "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, longer), (3, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (4, 3, 0)}
