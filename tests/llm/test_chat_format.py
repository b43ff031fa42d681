from hopweave.llm.chat_format import rotate

from .helpers import tuples

SCHEMA = "conv_id long, turn long, role string, text string"
HEAD = {"assistant": "<|im_start|>assistant\n", "system": "<|im_start|>system\n"}


def brute(data):
    out = {}
    for conv in {r[0] for r in data}:
        own = [r for r in data if r[0] == conv]
        speakers = {r[2] for r in own if r[2] not in (None, "system")}
        pieces = {}
        for r in sorted(own, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "unknown", r[3] or "")):
            stretch = None if r[1] is None else r[1] // 64
            last = [p for p in pieces if p[0] == stretch]
            at = (stretch, max((p[1] for p in last), default=0))
            if len(pieces.get(at, ())) == 256:
                at = (stretch, at[1] + 1)
            pieces.setdefault(at, []).append(r)
        for speaker in speakers:
            begins = 0
            for (stretch, piece), turns in pieces.items():
                text, masks = "", []
                for _, _, role, words in turns:
                    head = HEAD["assistant"] if role == speaker else HEAD["system"] if role == "system" else f"<|im_start|>user name={role or 'unknown'}\n"
                    start = len(text) + len(head)
                    text += head + (words or "") + "<|im_end|>\n"
                    if role == speaker:
                        masks.append((start, len(text)))
                out[conv, speaker, stretch, piece] = (begins, len(turns), len(masks), text, masks)
                begins += len(text)
    return out


def test_like_brute_force(spark):
    data = [(1, 0, "system", "rules"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi"), (1, 3, "cy", None), (1, 4, "ann", ""), (1, 5, None, "who?"), (1, None, "bob", "late")]
    data += [(2, 0, "system", "alone"), (None, 0, "ann", "no conversation"), (None, 1, "bob", "x")]
    data += [(3, t, "ab"[t % 2], "word " * (t % 5)) for t in range(300)] + [(3, 7, "b", "again")] * 2
    data += [(4, 1, "ann", "tie")] * 600 + [(5, 0, "assistant", "\U0001f600 long " * 20_000), (5, 1, "user", "ok")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3).selectExpr("*", "'x' as speaker", "'x' as stretch", "'x' as _at", "'x' as turns", "'x' as begins", "'x' as rendered")
    found = {(c, s, st, p): (b, n, own, text, [tuple(m) for m in masks]) for c, s, st, p, b, n, own, text, masks in tuples(rotate(df))}
    assert found == brute(data)
    for _, n, own, text, masks in found.values():
        assert all(text[:a].endswith("assistant\n") and text[a:b].endswith("<|im_end|>\n") for a, b in masks)


def test_empty(spark):
    assert rotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    df = rotate(spark.createDataFrame([(1, 0, "a", "b")], SCHEMA))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
