"""Jobs of the training-data operators that were once done in part."""

from stratalens.llm import decontam, jaccard, pii


def test_short_items_leak_within_a_budget_that_grows_with_them(spark):
    items = [(1, "What is the capital of France?"), (2, "x" * 50), (3, "  "), (4, "ART"), (5, "首都是哪里")]
    texts = ["He asks: what  is the\nCAPITAL of France? Paris.", "what is the capital of Frances", "whatever is said", "art", "start of an artist", "we call it art.", "中国的首都是哪里呢", "what is the capitol of france?", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.end_at) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): (0, 39), (1, 1): (1, 29), (7, 1): (1, 30), (3, 4): (0, 3), (5, 4): (0, 14), (6, 5): (0, 8)}
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == {2, 4, 8, 9}


def test_cards_beside_other_digits_and_keyed_secrets(spark):
    card, spaced, hexed = "4111111111111111", "4111 1111 1111 1111", "24be64439e3e49cf46b2d7c90f3602a3"
    texts = [f"pay {card} now", f"pay {spaced} 123 now", f"{card} 12/27", f"7 {card}", f"12 3456 {spaced} 98", f"{card} 2024-01-05", f"{card} 192.168.0.1", f"{card} 5500005555555559 {card}", f"{spaced} 212-555-0187", f"{card} 123-45-6789",
             'token="Ab9-xyzQ81_k"', hexed.upper(), hexed, "password: required", f"212 555 0187 {card}", "1 2 3 4 5 6 7 8 9 " * 2000, "api_key = me7@example.com1x.org", f"{card} 9{hexed[1:]}"]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").collect()}
    new = got[0].found[0].pseudonym
    kinds = {i: [f.kind for f in r.found] for i, r in got.items() if i != 15}
    assert kinds == {0: ["card"], 1: ["card"], 2: ["card"], 3: ["card"], 4: ["card"], 5: ["card", "date"], 6: ["card", "ip"], 7: ["card"] * 3, 8: ["card", "phone"], 9: ["card", "ssn"], 10: ["secret"], 11: ["secret"], 12: ["secret"], 13: [], 14: ["phone", "card"], 16: ["email"], 17: ["card", "secret"]}
    for i in (2, 3, 5, 6, 7, 8, 9, 14, 17):
        assert new in got[i].text.replace(" ", "") and card not in got[i].text.replace(" ", "")
    assert got[2].text == f"{new} 12/27" and got[3].text == f"7 {new}"
    assert [f.value for f in got[1].found] == [spaced] and got[1].text.replace(" ", "") == f"pay{new}123now"
    assert got[4].text.replace(" ", "") == f"123456{new}98"
    assert got[10].text.startswith('token="') and len(got[10].text) == len(texts[10]) and "Ab9-xyzQ81_k" not in got[10].text
    assert got[11].text == got[12].text.upper() and got[11].text != texts[11]
    assert len(got[15].text) == len(texts[15])


def test_near_duplicates_are_told_apart_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    # 2 has a copy of 1's text and another text; null ids: two texts of their own, one twice, and a copy of 1's
    rows = [(1, a), (2, a), (2, b), (None, c), (None, d), (None, d), (None, a), (3, e), (3, e), (4, e), (5, ""), (5, ""), (None, None)]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (None, d), (3, e), (5, ""), (5, ""), (None, None)], key=str)
