"""Scalar functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(s: Column, separator: str = ";") -> Column:
    """Parts of a list, trimmed, without empty ones; null and empty give an empty list."""
    parts = F.split(F.coalesce(s, F.lit("")), separator.replace(";", "[;]"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def split_list_or_null(s: Column, present: bool = True, separator: str = ";") -> Column:
    """A column that a file lacks is null; an empty value is an empty list."""
    return split_list(s, separator) if present else F.lit(None).cast("array<string>")


def parse_int(s: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(s).try_cast("int"), F.lit(default))


def parse_double(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def parse_boolean(s: Column) -> Column:
    """Null and empty: null; else whether it says true, in any case. Other words are false."""
    return F.when(s.isNotNull() & (s != ""), F.lower(F.trim(s)) == "true")


def sha256_text(s: Column) -> Column:
    return F.sha2(s, 256)


def prompt_signature(*templates: Column) -> Column:
    """One digest of templates, with a zero character between them."""
    return F.sha2(F.concat_ws("\0", *templates), 256)


def config_hash(settings: Mapping[str, Column]) -> Column:
    """Digest of key=value lines by key; null values are empty."""
    lines = [F.concat(F.lit(f"{k}="), F.coalesce(settings[k].cast("string"), F.lit("")), F.lit("\n")) for k in sorted(settings)]
    return F.sha2(F.concat(*lines), 256)


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets: neither order nor repeats count."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def same_text(a: Column, b: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def both_changed(a: Column, b: Column) -> Column:
    """Both are there and differ."""
    return F.coalesce(a != b, F.lit(False))


def tag_difference(have: Column, without: Column) -> Column:
    """Tags of one list that the other lacks, sorted and joined; repeats stay."""
    lacks = F.filter(F.coalesce(have, F.array().cast("array<string>")), lambda t: ~F.coalesce(F.array_contains(without, t), F.lit(False)))
    return F.array_join(F.array_sort(lacks), ";")


def distinct_union(a: Column, b: Column) -> Column:
    """Both lists, each value once, in the order of its first place."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits for each; empty and null: 0."""
    chars = F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != "")
    n = F.size(chars)

    def term(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return -p * F.log2(p)

    return F.coalesce(F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def csv_escape(s: Column) -> Column:
    """Quoted if it has a comma, quote or line end, or starts like a formula (which quoting alone doesn't defuse); null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), "").when(s.rlike('^[=+\\-@]|[,"\\n\\r]'), quoted).otherwise(s)


def _replaced(s: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def annotation_message(s: Column) -> Column:
    return _replaced(s, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")])


def annotation_property(s: Column) -> Column:
    return _replaced(annotation_message(s), [(":", "%3A"), (",", "%2C")])


def rule_name(rule_id: Column) -> Column:
    """Words between / and -, each with a capital first letter, joined."""
    return F.array_join(F.transform(F.split(rule_id, "[/-]"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def artifact_uri(fqcn: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.replace(fqcn, F.lit("."), F.lit("/")), F.lit(".java"))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def fqcn_of(package: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(package, F.lit("")), name)


def loc_of(begin: Column, end: Column) -> Column:
    return end - begin + 1


def positive_line(line: Column) -> Column:
    return F.when(line > 0, line)


def file_stem(path: Column, root: str, suffixes: Sequence[str]) -> Column:
    """Path below the root with dots for slashes, without the longest matching suffix, else without the last extension."""
    below = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + _quoted(root.rstrip("/") + "/"), "")
    out = F.regexp_replace(below, r"\.[^./]*$", "")
    for suffix in sorted(suffixes, key=len):
        out = F.when(F.endswith(below, F.lit(suffix)), F.left(below, F.length(below) - len(suffix))).otherwise(out)
    return F.replace(out, F.lit("/"), F.lit("."))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


#: Values that are summed in one inner array.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """For each size of a list the sum of those before it: over chunks, then inside each, so long lists aren't copied once per size."""

    def ahead(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def summed(own: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(CHUNK))
        bases = ahead(F.transform(firsts, lambda i: F.aggregate(F.slice(own, i, CHUNK), F.lit(0), lambda a, x: a + x)), F.lit(0))
        return let(bases, lambda known: F.flatten(F.transform(firsts, lambda i: ahead(F.slice(own, i, CHUNK), F.get(known, ((i - 1) / CHUNK).cast("int"))))))

    return let(sizes, summed)


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based place in a text."""
    return F.size(F.split(F.substring(text, F.lit(1), position - 1), "\n"))


def column_of(text: Column, position: Column) -> Column:
    """1-based column of a 1-based place in a text."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), position - 1), "\n", -1)) + 1


def masked(value: Column) -> Column:
    """The first and last two characters with stars for the rest; values of fewer than nine characters are all stars."""
    n = F.length(value)
    inner = F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    return F.when(n < 9, F.repeat(F.lit("*"), n)).otherwise(inner)
