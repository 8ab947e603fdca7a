"""Personal data in whole texts: fixed forms, and identifiers that bootstrapped contexts discover.

Only DataFrame operations: positions come from texts in which every match is marked and which are then split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, written

#: Marks before and after a match, what they become where a text has them already, and what hides a match.
OPEN, CLOSE, OTHER, HIDDEN = "\ue000", "\ue001", "\ue002", "\ue003"
KINDS = ("email", "ip", "card", "phone")
#: Each starts where the last match ended or where no character before could begin it, so a run is scanned once.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What may be an identifier that has no fixed form: something around @ or "(at)", groups of digits with one separator between, or a run of
#: six or more digits and separators. Where a run can start is settled by what is before, so runs are scanned once.
AROUND = r"(?<![^\s:=<(\"'])[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9.-]++"
GROUPS = r"(?<![\p{L}0-9._-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){2,4}(?![\p{L}0-9_])"
RUN = r"(?:(?<![\p{L}0-9._(-])\(|(?<![\p{L}0-9._-])[0-9])[0-9().-]{4,}[0-9](?![\p{L}0-9_])"
CANDIDATE = f"{AROUND}|{GROUPS}|{RUN}"
CANDIDATE_NEEDS = r"@|\(at\)|\[at\]|[0-9(][0-9().-]{4}[0-9]|[0-9]\)?[ .-][0-9]{2,5}[ .-][0-9]{2}"
#: Pieces whose lengths are summed in one inner array.
CHUNK = 256
#: A pattern needs so many different known instances (one word alone twice as many), and so high a score; so does an instance.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.8, 0.8
#: What an instance that may be of the kind but isn't known counts against a pattern, and what every pattern has against it.
UNKNOWN, DOUBT = 0.05, 0.25


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Of a string of digits: every second one from the right is doubled."""
    back = F.reverse(v)

    def one(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda v: F.length(digits_of(v)).between(13, 19) & luhn(digits_of(v)),
    "phone": lambda v: F.length(digits_of(v)).between(9, 15),
}


def pieces(text: Column, pattern: str, needs: str) -> Column:
    """Text outside and inside of matches, in turn (one piece: no match)."""
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")
    return F.when(text.rlike(needs), F.split(marked, f"[{OPEN}{CLOSE}]")).otherwise(F.array(text))


def starts_of(parts: Column) -> Column:
    """Where each piece starts, in code points: sums over chunks, then inside each, so that long arrays aren't copied once per piece."""
    sizes = F.transform(parts, lambda p: F.length(p))
    firsts = F.sequence(F.lit(1), F.size(parts), F.lit(CHUNK))
    running = "array<int>"

    def ahead(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast(running).alias("all"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    sums = F.transform(firsts, lambda i: F.aggregate(F.slice(sizes, i, CHUNK), F.lit(0), lambda a, x: a + x))
    bases = ahead(sums, F.lit(0))
    return F.flatten(F.transform(firsts, lambda i: ahead(F.slice(sizes, i, CHUNK), F.get(bases, ((i - 1) / CHUNK).cast("int")))))


def contexts(before: Column, after: Column) -> Column:
    """Lexical patterns around a match, lower-cased: the two words before, the word before, the word after, and the words on both sides.

    A word before has what is between it and the match, if that is only white space, as one space. Whole words, however long.
    """
    b, a = F.lower(before), F.lower(after)
    one = F.regexp_extract(b, r"(?<!\S)(\S++)\s*+$", 1)
    two = F.regexp_replace(F.regexp_extract(b, r"(?<!\S)(\S++\s++\S++)\s*+$", 1), r"\s+", " ")
    gap = F.when(b.rlike(r"\s$"), " ").otherwise("")
    after_it = F.regexp_extract(a, r"^\s*+(\S++)", 1)
    made = F.array(
        F.when(two != "", F.concat(F.lit("2"), two, gap)),
        F.when(one != "", F.concat(F.lit("1"), one, gap)),
        F.when(after_it != "", F.concat(F.lit("a"), after_it)),
        F.when((one != "") & (after_it != ""), F.concat(F.lit("b"), one, gap, F.lit(HIDDEN), after_it)),
    )
    return F.array_compact(made)


def found(parts: Column, starts: Column, kind: Column, valid: Callable[[Column], Column]) -> Column:
    """Valid matches as structs (kind, start, end, value, contexts)."""
    def one(p: Column, i: Column) -> Column:
        at = F.get(starts, i)
        return F.struct(kind.alias("kind"), at.alias("start"), (at + F.length(p)).alias("end"), p.alias("value"), contexts(F.get(parts, i - 1), F.coalesce(F.get(parts, i + 1), F.lit(""))).alias("contexts"))

    every = F.filter(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & valid(p), one(p, i))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 1, every).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string,contexts:array<string>>>"))


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, base, maybe): base spans by kind and start, and candidates that overlap none of them."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE + HIDDEN, OTHER * 3)
    # a text without a digit or @ is not looked at again
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(F.col(text).rlike(r"[0-9@]|\(at\)|\[at\]"), clean).otherwise("").alias("t"))
    df = df.withColumn("left", F.col("t"))
    arrays = []
    for n, kind in enumerate(KINDS):
        df = df.withColumn("p", pieces(F.col("t"), PATTERNS[kind], NEEDS[kind]))
        df = df.withColumn("s", F.when(F.size("p") > 1, starts_of(F.col("p"))))
        df = df.withColumn(kind, found(F.col("p"), F.col("s"), F.lit(n), VALID[kind]))
        # matches of the next kinds are sought in the whole text again; only candidates are sought in what is left
        spans = F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        df = df.withColumn("left", F.when(F.size(kind) > 0, blotted(F.col("left"), spans)).otherwise(F.col("left")))
        arrays.append(F.col(kind))
    df = df.withColumn("p", pieces(F.col("left"), CANDIDATE, CANDIDATE_NEEDS))
    df = df.withColumn("s", F.when(F.size("p") > 1, starts_of(F.col("p"))))
    maybe = found(F.col("p"), F.col("s"), F.lit(-1), lambda v: ~v.contains(HIDDEN))
    return df.select("row", "id", F.concat(*arrays).alias("base"), maybe.alias("maybe"))


def blotted(text: Column, spans: Column) -> Column:
    """text with spans (ascending, disjoint) blotted out: the stretch before each span and the span, then the rest."""
    n = F.size(spans)

    def end_before(i: Column) -> Column:
        return F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))

    parts = F.transform(spans, lambda x, i: F.concat(F.substring(text, end_before(i) + 1, x["start"] - end_before(i)), F.repeat(F.lit(HIDDEN), x["end"] - x["start"])))
    return F.concat(F.array_join(parts, ""), F.substring(text, end_before(n) + 1, F.length(text)))


def may_be(kind: Column, value: Column) -> Column:
    """Whether a candidate can be of a kind at all."""
    n = F.length(digits_of(value))
    at = value.rlike(r"@|\(at\)|\[at\]")
    dotted = value.rlike(r"^[0-9]+(\.[0-9]+)+$")
    return F.when(kind == 0, at).when(kind == 1, dotted & value.rlike(rf"^{PART}(\.{PART}){{2,}}$")).when(kind == 2, ~at & ~dotted & n.between(13, 19) & luhn(digits_of(value))).otherwise(~at & ~dotted & n.between(7, 15))


def graph(scan: DataFrame) -> DataFrame:
    """(pattern, value, kinds): each pattern with each value that stands in it, once; kinds has a bit for each kind that the value is by its form."""
    of = lambda c: scan.select(F.explode(c).alias("x")).select(F.explode("x.contexts").alias("pattern"), F.col("x.value").alias("value"), F.col("x.kind").alias("kind"))
    bit = F.when(F.col("kind") >= 0, F.expr("shiftleft(1, kind)")).otherwise(0)
    return of("base").union(of("maybe")).groupBy("pattern", "value").agg(F.bit_or(bit).alias("kinds"))


def judged(edges: DataFrame, known: DataFrame, support: int) -> DataFrame:
    """(pattern, kind, value, belief, unknown): of patterns with enough known instances of a kind all that stands in them."""
    need = F.when(F.substring("pattern", 1, 1).isin("2", "b"), support).otherwise(2 * support)
    enough = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("pattern", "kind")
    rows = edges.join(enough, "pattern").join(known, ["value", "kind"], "left")
    return rows.select("pattern", "kind", "value", "belief", (F.col("belief").isNull() & (F.col("kinds") == 0) & may_be(F.col("kind"), F.col("value"))).alias("unknown"))


def bootstrapped(edges: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(value, kind) of candidates that are identifiers, by rounds until one adds none.

    Known instances are, at first, those with a fixed form. A pattern's score for a kind is the belief in its known instances over that, its
    instances that can't be of the kind, and a little for those that may be and aren't known, and for doubt. A candidate's belief is one
    less the product of the doubts of the good patterns around it. What is believed enough is known in the next round, with its belief, so patterns
    that no seed stands in are induced as well. All is aggregates and joins on keys.
    """
    known = written(edges.where("kinds > 0").select("value", F.explode(F.expr("filter(array(0, 1, 2, 3), k -> kinds & shiftleft(1, k) > 0)")).alias("kind")).distinct().withColumn("belief", F.lit(1.0)), "known")
    first = known
    while True:
        rows = written(judged(edges, known, support), "judged")
        sums = rows.groupBy("pattern", "kind").agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("sure"), F.count_if(F.col("belief").isNull() & ~F.col("unknown")).alias("against"), F.count_if("unknown").alias("open"))
        good = sums.select("pattern", "kind", (F.col("sure") / (F.col("sure") + F.col("against") + UNKNOWN * F.col("open") + DOUBT)).alias("score")).where(F.col("score") >= PATTERN_SCORE)
        doubts = rows.where("unknown").join(good, ["pattern", "kind"]).groupBy("value", "kind").agg(F.sum(F.log1p(-F.least("score", F.lit(0.999)))).alias("doubt"))
        # of several kinds the one that is believed most, then the first
        best = doubts.groupBy("value").agg(F.min(F.struct(F.exp("doubt").alias("doubt"), "kind")).alias("b"))
        more = best.select("value", "b.kind", (1 - F.col("b.doubt")).alias("belief")).where(F.col("belief") >= INSTANCE_SCORE).join(known.select("value"), "value", "left_anti")
        new = written(more, "new")
        forget(rows)
        if new.isEmpty():
            forget(new)
            break
        before, known = known, written(known.union(new), "known")
        forget(new, before if before is not first else None)
    found = written(known.join(first.select("value"), "value", "left_anti").select("value", "kind"), "found")
    forget(first, known)
    return found


def discovered(scan: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(row, kind, start, end) of every occurrence of the candidates that bootstrapping finds to be identifiers."""
    edges = written(graph(scan), "edges")
    found = bootstrapped(edges, support)
    forget(edges)
    maybe = scan.select("row", F.explode("maybe").alias("x")).select("row", "x.value", "x.start", "x.end")
    return maybe.join(found, "value").select("row", "kind", "start", "end")


def of_kind(n: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == n


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_new) of every row of docs.

    Base spans are the leftmost non-overlapping matches of each kind's form that hold (address parts, Luhn, digits); kinds may overlap. spans has these
    and the discovered ones, as kind:start:end in code points. Null and empty texts have none; rows with equal or null ids
    each keep their own result; an empty table gives none; other columns are ignored.
    """
    scan = written(scanned(docs, text, id_col), "scan")
    new = discovered(scan).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    all_rows = scan.select("row", "id", F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"))
    both = all_rows.join(new, "row", "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    base, spans = F.array_sort("base"), F.array_sort(F.concat("base", "new"))
    count = [F.size(F.filter("base", of_kind(n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return both.select(F.col("id").alias(id_col), *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size("new").cast("long").alias("n_new"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
