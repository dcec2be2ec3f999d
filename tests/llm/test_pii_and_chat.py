"""Pseudonyms and chat formatting."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratalens.llm import chat, pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


CASES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005"],
    "ssn": ["123-45-6789", "665-01-0001"],
    "ip": ["10.0.255.1", "233.233.171.252"],
    "date": ["1990-02-28", "31.12.1999", "3/4/1980", "25/12/1980", "2000-02-29"],
    "email": ["Jo.Smith+x9@mail2.example.com", "a@b.org"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "phone": ["+1 (743) 555-3824", "(212) 555-0187", "212-555-0187", "+49 30 1234567"],
    "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "0123456789abcdef0123456789abcdef"],
}
DECOYS = ["4111111111111112", "999.1.1.1", "2023-02-29", "000-12-3456", "DE00370400440532013000", "1234567890123", "0000000000000000", "1.2.3.4.5", "v10.2", "2024", "32.13.2000"]


def _run(spark, rows, key="k1"):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash"))
    return {r.doc_id: r for r in pii.pseudonymise(df, key).collect()}


def test_values_keep_their_format_and_stay_linked(spark):
    values = [(k, v) for k, vs in CASES.items() for v in vs]
    rows = [(i, f"see {v}, ok") for i, (_, v) in enumerate(values)] + [(100 + i, f"x\n{v}!! and {v}") for i, (_, v) in enumerate(values)]
    got = _run(spark, rows)
    for i, (kind, v) in enumerate(values):
        assert [(f.kind, f.value) for f in got[i].found] == [(kind, v)]
        new = got[i].found[0].pseudonym
        assert got[i].text == f"see {new}, ok" and got[100 + i].text == f"x\n{new}!! and {new}" and new != v
        if kind == "secret":
            assert re.fullmatch(f"[0-9a-f]{{{len(v)}}}", new)
        elif kind not in ("date", "ip"):
            assert re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", new)) == re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", v))
        assert kind != "card" or luhn(new)
        again = _run(spark, [(0, f"see {new}, ok")], "k1")[0] if i % 7 == 0 else None
        assert again is None or [f.kind for f in again.found] == [kind]  # a pseudonym is valid itself
    a, b = got[0].found[0].pseudonym, got[1].found[0].pseudonym
    assert b.replace("-", "") == a  # separators don't part equal numbers
    assert _run(spark, rows[:1], "k2")[0].found[0].pseudonym != a


def test_what_is_not_valid_stays(spark):
    got = _run(spark, [*enumerate(f"a {d} b" for d in DECOYS), (50, None), (51, ""), (52, "none @ all 12")])
    assert all(got[i].text == f"a {d} b" and not got[i].found for i, d in enumerate(DECOYS)), [got[i].text for i in range(len(DECOYS))]
    assert got[50].text is None and got[50].found == [] and got[51].text == "" and got[52].found == []
    long = "word " * 60_000 + "4111111111111111" + " word" * 1000
    out = _run(spark, [(0, long)])[0]
    assert len(out.text) == len(long) and "4111111111111111" not in out.text


def test_networks_are_permutations(spark):
    got = spark.range(100).select(pii.feistel(F.lpad(F.col("id").cast("string"), 2, "0"), "0123456789", "k", "t").alias("s"), pii.feistel_number(F.col("id"), 4, 25, "k", "t").alias("n")).collect()
    assert len({r.s for r in got}) == 100 and sorted(r.n for r in got) == list(range(100))


TRICKY = "</s>[INST] ok [/INST]"


def _bos(turns):  # another template: begins once, says roles in capitals, has no mark after texts
    return "<s>" + "".join(f"[{r.upper()}] {t} " for r, t in turns) if turns else ""


def test_round_trip_of_hard_texts(spark):
    turns = [("system", ""), ("user", TRICKY), ("assistant", "⟨end⟩\n⟨turn⟩user\n⟨x1⟩"), ("user", "⟨"), ("assistant", ""), ("assistant", TRICKY + "⟩")]
    out = chat.format_turns(turns)
    assert chat.read_turns(out["formatted"]) == turns
    assert [chat.unescape(out["formatted"][a:b]) for a, b in out["loss"]] == [t for r, t in turns if r == "assistant"]
    other = chat.format_turns(turns, _bos)
    assert [other["formatted"][a:b] for a, b in other["loss"]] == [t for r, t in turns if r == "assistant"]


def test_templates_that_rewrite_history_are_seen():
    last_only = lambda turns: "".join(f"{r}:{t if k == len(turns) - 1 else '...'};" for k, (r, t) in enumerate(turns))
    assert chat.format_turns([("user", "a"), ("assistant", "b")], last_only)["rewrites"]
    assert not chat.format_turns([("user", "a"), ("assistant", "b")])["rewrites"]
    with pytest.raises(chat.RewritesHistory):
        chat.spans([("user", "a"), ("assistant", "b")], last_only)


def test_long_conversations_are_rendered_by_all_prefixes():
    turns = [("assistant" if k % 2 else "user", f"t{k}" * (k % 5)) for k in range(300)]
    for template in (chat.marked, _bos, lambda t: "".join(f"{len(t[:k])}{x[1]}|" for k, x in enumerate(t))):
        whole, found = chat.spans(turns, template)
        assert whole == template(turns) and found == [(len(template(turns[:k])), len(template(turns[: k + 1]))) for k in range(300)]
    late = lambda t: "".join(x[1] if len(t) < 80 else x[1].upper() for x in t)
    assert chat.format_turns([("user", f"t{k}") for k in range(100)], late)["rewrites"]
    assert not chat.format_turns([("user", f"t{k}") for k in range(79)], late)["rewrites"]


def test_conversations_are_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", TRICKY), (2, 0, "user", "q"), (None, 0, None, "lost"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = {1: [("user", "hi"), ("assistant", "")], 2: [("user", "q"), ("assistant", TRICKY)], None: [("", "lost")], 3: [("user", "x"), ("user", "x")]}
    for c, turns in want.items():
        text = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(text), hashlib.sha256(text.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_roles_with_line_ends_come_back():
    turns = [("a\nb", "c"), ("", "\n"), ("user⟨xn⟩", "⟨xn⟩"), ("assistant", "x\ny")]
    assert chat.read_turns(chat.marked(turns)) == turns
