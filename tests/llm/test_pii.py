import hashlib
import random
import re

from pyspark.sql import Row

from sparkledger.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in FORMS.items()}


def row(doc, text):
    b = base(text)
    listed = ",".join(f"{k}:{s}:{e}" for k in FORMS for s, e in b[k])
    return (repr(doc), *(len(b[k]) for k in FORMS), hashlib.sha256(listed.encode()).hexdigest(), listed)


def texts():
    rng = random.Random(9)
    parts = ["a.b@c.de", "@", ".", "_", "x@y", "@z.com", "+1 (743) 555-3824", "4111 1111 1111 1111", "4111111111111112", "10.0.0.255", "10.0.0.256", "1.2.3.4.5.6.7.8", "000255.1.01.1", "12-34", "+", "é", "😀", "", "", "", " ", "\n", "-", "7", "5500-0000-0000-0004", "word", "(at)", "123456789012345678901234567890"]
    out = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(600)]
    out += [None, "", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "a@" * 20_000, "1.1.1.1 " * 1500, "+1 234 567 890, " * 700, "x@y.z_a@b.c", "😀 a@b.cd 😀 +12 345 678 901"]
    return out


def test_base_spans_match_the_forms(spark):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())] + [(7, "a@b.cd"), (7, "a@b.cd")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, row="r", id="i", kind=1, left="l") for i, t in rows], "doc_id long, text string, row string, id string, kind int, left string")
    out = pii.find_pii(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    got = out.collect()
    assert sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(row(i, t)[:-1] for i, t in rows)
    want = sorted((repr(i), row(i, t)[-1]) for i, t in rows)
    for (d, listed), (w, expected) in zip(sorted((repr(r.doc_id), r.spans) for r in got if not r.n_new), [x for x in want]):
        if d == w and len(got) == sum(not r.n_new for r in got):
            assert listed == expected


def test_contexts_discover_more(spark):
    rng = random.Random(1)
    rows = [(i, f"Some text. reach me: user{i}@mail{i}.com and more") for i in range(8)]
    rows += [(100 + i, f"Then reach me: person{i}(at)host.example please") for i in range(3)]
    rows += [(200, "Nobody else here: person9(at)host.example it is"), (201, "the number is 20240101 here"), (202, "reach me: soon")]
    rows += [(300 + i, f"please call now +1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} ok") for i in range(6)] + [(400, "please call now 555-123-4567 ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    text = dict(rows)
    for i in (100, 101, 102, 400):
        kind, a, b = got[i].spans.split(":")
        assert (kind, text[i][int(a) : int(b)]) == (("email", f"person{i - 100}(at)host.example") if i < 400 else ("phone", "555-123-4567"))
        assert got[i].n_email == got[i].n_phone == 0 and got[i].n_new == 1
    assert all(got[i].spans == "" for i in (200, 201, 202)) and all(got[i].n_email == 1 and not got[i].n_new for i in range(8))


def test_discovered_identifiers_induce_patterns(spark):
    """Seeds stand in one context; what is found there also stands in a second, where others are that no seed is near."""
    rows = [(i, f"Words {i} before. contact person: user{i}@mail{i}.com thanks {i}") for i in range(5)]
    rows += [(100 + i, f"Words {i} before. contact person: pat{i}(at)host{i}.example thanks {i}") for i in range(6)]
    rows += [(200 + i, f"Another text {i}. write to mailbox pat{i}(at)host{i}.example soon {i}") for i in range(6)]
    rows += [(300 + i, f"A third text {i}. write to mailbox kim{i}(at)home{i}.example soon {i}") for i in range(4)]
    rows += [(400, "unrelated: box9(at)else.example here"), (401, "pat2(at)host2.example stands alone elsewhere")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_new for i in (*range(100, 106), *range(200, 206), *range(300, 304))] == [1] * 16
    assert got[400].n_new == 0 and got[401].n_new == 1 and all(got[i].n_new == 0 for i in range(5))


def test_planted_identifiers_at_a_stated_precision(spark):
    """Of what is discovered among many numbers and names, nearly all is planted, and nearly all that is planted is discovered."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    rows, planted = [], {}
    for i in range(400):
        kind = i % 4
        mail, phone = f"{word()}{i}(at){word()}.example", f"0{digits(3)} {digits(3)} {digits(4)}"
        if kind == 0:
            text = f"{word()} {word()} please mail to {word()}{i}@{word()}.com {word()} or dial number +49 {digits(3)} {digits(3)} {digits(4)} {word()}"
        elif kind == 1:
            planted[i] = {mail, phone}
            text = f"{word()} {word()} please mail to {mail} {word()} or dial number {phone} {word()}"
        else:
            text = f"{word()} order {digits(8)} of {digits(3)}-{digits(4)}, at {word()}(at){word()} {word()} {digits(9)}.{word()}"
        rows.append((i, text))
    text = dict(rows)
    found = {}
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.n_new:
            base = {(a, b) for k, p in FORMS.items() for a, b in [m.span() for m in re.finditer(p, text[r.doc_id]) if holds(k, m[0])]}
            spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")]
            found[r.doc_id] = {text[r.doc_id][a:b] for a, b in spans if (a, b) not in base}
    hits = sum(len(found.get(i, set()) & p) for i, p in planted.items())
    assert hits / sum(map(len, found.values())) >= 0.95 and hits / sum(map(len, planted.values())) >= 0.95


def test_long_words_and_runs(spark):
    long = "x" * 70_000
    rows = [(i, f"{long}{i} {'y' * 500}: u{i}@m{i}.de") for i in range(4)] + [(9, f"{long}0 {'y' * 500}: {'n' * 100}(at)home.example")] + [(10, "(" * 20_000 + "1" * 20_000 + "(1" * 20_000), (11, "1 2 " * 20_000), (12, "12 34 56 " * 10_000)]
    got = {r.doc_id: r.n_new for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 8 and got[9] == 0
    rows = [(i, f"is {'y' * 500}: u{i}@m{i}.de") for i in range(4)] + [(9, f"is {'y' * 500}: {'n' * 100}(at)home.example"), (10, f"is {'y' * 499}z: {'n' * 99}(at)home.example")]
    got = {r.doc_id: r.n_new for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1, 10: 0}


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
