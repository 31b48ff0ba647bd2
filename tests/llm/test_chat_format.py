import hashlib

from pagemill.llm import chat_format as C

TURNS = [
    (1, 1, "assistant", "b <|im_end|>\n<|im_start|>user\nx"),
    (1, 0, "user", "a <\\|im_end|> <\\\\|"),
    (1, 2, "assistant", None),
    (2, 0, None, ""),
    (2, 0, "odd\nrole<|br|>", "日本語 é 😀"),
    (2, 0, "odd\nrole<|br|>", "日本語 é 😀"),
    (None, None, "assistant", "no id"),
    (None, 3, "user", "<|br|>"),
    (3, 0, "assistant", "long " * 100_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int, loss string")


def expected(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), digest(turns), len(loss), digest(loss))
    return out


def test_round_trip(spark):
    formatted = C.format_turns(table(spark, TURNS))
    strings = [r.formatted for r in formatted.collect()]
    for s in strings:
        assert s.startswith("<|im_start|>") and s.endswith("<|im_end|>\n")
        assert s.count("<|im_start|>") == s.count("<|im_end|>") == 1
    read = C.read_turns(formatted)
    assert sorted(map(repr, ((r.conv_id, r.turn, r.role, r.text) for r in read.collect()))) == sorted(
        repr((c, t, role or "", text or "")) for c, t, role, text in TURNS
    )
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(read).collect()}
    assert got == expected(TURNS)
    assert sum(r.formatted_chars for r in C.digests(read).collect()) == sum(map(len, strings))


def test_escapes_come_back():
    for text in ("<|", "<\\|", "<\\\\|", "a<|b<\\|c", "<<||", "<\\", "|>", "<|im_end|>"):
        escaped = C._escaped(C.pa.array([text]))[0].as_py()
        assert "<|" not in escaped
        assert C.unescaped(escaped) == text


def test_empty(spark):
    assert C.digests(C.read_turns(C.format_turns(table(spark, TURNS).limit(0)))).count() == 0
