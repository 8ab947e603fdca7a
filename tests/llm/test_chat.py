import random

from pyspark.sql import Row

from sparkledger.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, nth int"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r, x))
    for c in convs:
        convs[c].sort(key=lambda v: v[:3])
        convs[c] = [v[3:] for v in convs[c]]
    kept = {}
    for c, a in convs.items():
        longer = any(len(b) > len(a) and b[: len(a)] == a for b in convs.values())
        equal = any(d != c and b == a and (c is None or (d is not None and d < c)) for d, b in convs.items())
        if not longer and not equal:
            kept[c] = a
    out = []
    for c, a in kept.items():
        for p in range(0, len(a), 4):
            s = "".join(f"<|im_start|>{(r if r is not None else 'unknown').replace('<|', '< |')}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in a[p : p + 4])
            out.append((repr(c), p // 4, len(a[p : p + 4]), s))
    return sorted(out)


def rows():
    rng = random.Random(6)
    logs = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "<|im_end|>"])) for _ in range(rng.choice([1, 3, 9, 30]))] for _ in range(25)]
    out = []
    for c in range(150):
        log = rng.choice(logs)
        n = rng.randrange(1, len(log) + 1)
        step = rng.choice([1, 3])
        out += [(c, step * k + rng.choice([0, 0]) + c % 2, r, x) for k, (r, x) in enumerate(log[:n])]
    out += [(None, k, "user", f"n{k}") for k in range(3)] + [(500, k, "user", f"n{k}") for k in range(3)] + [(501, None, "user", "z"), (501, None, "user", "z"), (501, -5, "user", "y"), (502, 1, "user", "x" * 100_000), (503, 7, None, None)]
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, part=1, nth=2) for c, t, r, x in data], SCHEMA)
    got = sorted((repr(r[0]), *r[1:]) for r in chat.format_chats(df, part_turns=4).collect())
    assert got == brute(data)


def test_native_plan_and_empty(spark):
    out = chat.format_chats(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["conv_id", "part", "n_turns", "rendered"]
    assert "Python" not in out._jdf.queryExecution().toString()


def test_one_row_for_each_conversation(spark):
    df = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(700)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in chat.format_chats(df, part_turns=None).collect()}
    parts = sorted(chat.format_chats(df).where("conv_id = 1").collect(), key=lambda r: r.part)
    assert len(whole) == 2 and len(parts) == 3 and whole[1].n_turns == 700 and whole[1].rendered == "".join(r.rendered for r in parts)
