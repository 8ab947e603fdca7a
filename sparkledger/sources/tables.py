"""Inventories, caches, mappings, overrides, rules and answers as DataFrames."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as C
from ..operators.findings import Rule
from ..operators.suggestions import suggestion_of
from ..schemas import CACHE_ENTRY, MAPPING, OVERRIDE, SCAN_RECORD


def parse_csv_line(line: str) -> list[str]:
    """Fields between commas; quotes enclose a field, two of them are one. A quote that isn't closed runs to the end."""
    out, field, quoted, at = [], [], False, 0
    while at < len(line):
        c = line[at]
        if quoted:
            if c == '"' and line[at + 1 : at + 2] == '"':
                field.append('"')
                at += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"':
            quoted = True
        elif c == ",":
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        at += 1
    return [*out, "".join(field)]


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """Paths of a file's parts in the order of their names, as a reader takes them: decoded, and no sign of them is a pattern."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(p)) for p in sorted(spark.read.text(path).inputFiles())]


def place() -> F.Column:
    """Orders the rows of a source by file name, then by their place in the file, however files are split and dealt to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def header_of(spark: SparkSession, parts: Sequence[str]) -> tuple[list[str], int]:
    """The names in the head, which is the first line of all that is neither blank nor a comment, and the number of its part."""
    for n, part in enumerate(parts):
        first = spark.read.text(part).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).limit(1).collect()
        if first:
            return parse_csv_line(first[0].value), n
    return [], 0


def metadata_of(spark: SparkSession, path: str, key: str = "scan_timestamp") -> str | None:
    row = spark.read.text(path).where(F.startswith("value", F.lit(f"# {key}:"))).limit(1).collect()
    return row[0].value.split(":", 1)[1].strip() if row else None


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Scan rows with seq (the row's place), bound by the names in the head, in any order; lines that start with # aren't rows.

    path is a file, or a folder whose files in the order of their names are one inventory: the first of them has a head, others may repeat it.
    fqcn and method must be there; every other column may be missing. Physical lines are rows, as they are when such files are compared.
    """
    parts = parts_of(spark, path)
    names, at = header_of(spark, parts)
    for c in ("fqcn", "method"):
        if c not in names:
            raise ValueError(f"the inventory has no column {c}")
    kind = ", ".join(f"`{n}` string" for n in names)
    read = lambda some, header: spark.read.csv(some, schema=kind, header=header, comment="#", escape='"', nullValue=None, emptyValue="", mode="PERMISSIVE", enforceSchema=True).withColumn("seq", place())
    raw = read(parts[at], True)
    if parts[at + 1 :]:
        # a reader that expects heads would take a row of each other part for one; a part may repeat the head
        rest = read(parts[at + 1 :], False)
        raw = raw.union(rest.where(~F.forall(F.array(*(F.col(f"`{n}`").eqNullSafe(F.lit(n)) for n in names)), lambda same: same)))
    return records_of(raw, names)


def records_of(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns as a scan row; what is absent is null, and only an absent ai_tags column is null."""
    have = set(names)
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    keep = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    return raw.select(
        "seq", keep("fqcn").alias("fqcn"), keep("method").alias("method"), C.parse_int(text("loc")).alias("loc"), C.split_list(text("tags")).alias("tags"), keep("display_name").alias("display_name"),
        text("content_hash").alias("content_hash"), C.parse_boolean(text("ai_security_relevant")).alias("ai_security_relevant"), text("ai_display_name").alias("ai_display_name"),
        C.split_list_or_null(text("ai_tags"), "ai_tags" in have).alias("ai_tags"), text("ai_reason").alias("ai_reason"), C.parse_double(text("ai_confidence")).alias("ai_confidence"),
        C.parse_double(text("ai_interaction_score")).alias("ai_interaction_score"), text("tag_ai_drift").alias("tag_ai_drift"),
    ).select("seq", *SCAN_RECORD.names)


def looks_like_json_lines(text: str) -> bool:
    return text.lstrip().startswith("{")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(seq, content_hash, prompt_signature, suggestion, secrets) of cache lines; lines that aren't objects, or have no hash, are dropped.

    seq orders lines by file name, then by their place in the file, however files are split over tasks.
    """
    rows = spark.read.schema(CACHE_ENTRY).json(path, mode="DROPMALFORMED").where(F.col("contentHash").isNotNull())
    return rows.select(place().alias("seq"), F.col("contentHash").alias("content_hash"), F.col("promptSignature").alias("prompt_signature"), "suggestion", F.col("suggestion.secrets").alias("secrets"))


def parse_mapping(text: str) -> tuple[dict[str, str], list[tuple]]:
    """Framework, version and source, and rows (tag, tag_pos, pos, control_id, chapter, chapter_title). Raises ValueError where the document is wrong."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or doc.get("schemaVersion") != "1":
        raise ValueError("the mapping's schemaVersion must be \"1\"")
    for k in ("framework", "frameworkVersion"):
        if not isinstance(doc.get(k), str) or not doc[k].strip():
            raise ValueError(f"the mapping has no {k}")
    tags = doc.get("tagToControls")
    if not isinstance(tags, dict) or not tags:
        raise ValueError("the mapping has no tagToControls")
    rows = []
    for n, (tag, controls) in enumerate(tags.items()):
        if not tag.strip() or not isinstance(controls, list) or not controls:
            raise ValueError(f"the mapping of {tag!r} names no control")
        for k, c in enumerate(controls):
            if not isinstance(c, dict) or not str(c.get("id") or "").strip():
                raise ValueError(f"a control of {tag!r} has no id")
            rows.append((tag, n, k, c["id"], c.get("chapter"), c.get("chapterTitle")))
    return {"framework": doc["framework"], "version": doc["frameworkVersion"], "source": doc.get("source") or ""}, rows


def read_mapping(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    text = spark.read.text(path, wholetext=True).first().value
    about, rows = parse_mapping(text)
    return about, spark.createDataFrame(rows, MAPPING)


def _yaml(text: str):
    import yaml

    return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}


def override_row(n: int, o: Mapping | None) -> tuple | None:
    """OVERRIDE of the n-th entry of a document; None without a class."""
    if not o or not str(o.get("fqcn") or "").strip():
        return None
    tags = o.get("tags")
    return n, o["fqcn"], o.get("method"), o.get("securityRelevant"), None if tags is None else [str(t) for t in tags], o.get("displayName"), o.get("reason"), o.get("note")


def read_overrides(spark: SparkSession, text: str) -> DataFrame:
    """Rows of an override document in their order; those without a class are dropped, keys that aren't known don't matter.

    For texts that a person edits: it is parsed on the driver. read_override_file() is for any number of entries.
    """
    rows = (override_row(n, o) for n, o in enumerate(_yaml(text).get("overrides") or []))
    return spark.createDataFrame([r for r in rows if r], OVERRIDE)


#: A document of one entry on each line has this head; its entries begin and end so.
OVERRIDES_HEAD, OVERRIDES_ENTRY = "overrides:", r"(?s)^- \{.*\}\s*$"


def read_override_file(spark: SparkSession, path: str) -> DataFrame:
    """read_overrides() of a file, or of a folder whose files in the order of their names are one document.

    Where each entry has a line of its own (as documents.write_overrides puts them), tasks parse the lines and only the number of entries of each
    block comes to the driver. A document in any other layout is parsed as a whole there.
    """
    lines = spark.read.text(path).select(place().alias("at"), "value")
    kind = F.when(F.col("value").rlike(OVERRIDES_ENTRY), "entry").when(F.rtrim("value") == OVERRIDES_HEAD, "head").when(F.col("value").rlike(r"^\s*(#|$)"), "none").otherwise("other")
    sizes = lines.groupBy("at.file", "at.block").agg(*(F.count_if(kind == k).alias(k) for k in ("entry", "head", "other"))).orderBy("file", "block").collect()
    if sum(x.other for x in sizes) or sum(x.head for x in sizes) != 1:
        return read_overrides(spark, "\n".join(r.value for r in lines.orderBy("at").collect()))
    offsets, n = {}, 0
    for x in sizes:
        offsets[x.file, x.block] = n
        n += x.entry

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lines of a block follow each other in one task
        block, n = None, 0
        for batch in batches:
            rows = []
            for *at, value in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    block, n = at, offsets[tuple(at)]
                rows.append(override_row(n, _yaml(value)[0]))
                n += 1
            columns = list(zip(*(r for r in rows if r))) or [()] * len(OVERRIDE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    kinds = to_arrow_schema(OVERRIDE)
    return lines.where(kind == "entry").select("at.file", "at.block", "value").mapInArrow(each, OVERRIDE)


def read_rules(text: str) -> tuple[list[Rule], str]:
    """Rules of a catalogue and the digest of its text. Ids must differ."""
    rules = [Rule(r["id"], r["category"], tuple(r.get("anchors") or ()), r["pattern"], float(r.get("entropyMin") or 0), r.get("description") or "", r.get("provenance") or "") for r in _yaml(text).get("rules") or []]
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rule ids repeat")
    return rules, hashlib.sha256(text.encode()).hexdigest()


def read_manual_responses(classes: DataFrame, folder: str) -> DataFrame:
    """classes (file_stem, fqcn) with the suggestion in folder/<stem>.response.txt; without a file, or an object in it, an empty one."""
    spark = classes.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.response.txt").load(folder)
    stem = F.regexp_extract("path", r"([^/]*)\.response\.txt$", 1)
    return with_manual_responses(classes, files.select(stem.alias("file_stem"), F.decode("content", "UTF-8").alias("response")))


def with_manual_responses(classes: DataFrame, answers: DataFrame) -> DataFrame:
    """classes (file_stem, fqcn) with the suggestion in answers (file_stem, response)."""
    joined = classes.join(answers, "file_stem", "left")
    s = suggestion_of(F.col("response"))
    none = F.from_json(F.to_json(F.struct(F.col("fqcn").alias("className"))), s_schema()).withField("methods", F.from_json(F.lit("[]"), s_schema()["methods"].dataType))
    return joined.withColumn("suggestion", F.coalesce(s, none)).drop("response")


def s_schema():
    from ..schemas import CLASS_SUGGESTION

    return CLASS_SUGGESTION


#: Settings of a run and their defaults; a file sets them first, then arguments do.
DEFAULTS: dict[str, object] = {"outputMode": "csv", "contentHash": False, "driftDetect": False, "securityOnly": False, "minConfidence": 0.0, "aiEnabled": False, "confidence": False, "maxClassChars": 40_000, "mismatchLimit": -1, "fileSuffixes": [], "testMarkers": [], "plugins": [], "detectSecrets": False, "secretsInclude": None}


def read_config(text: str, arguments: Mapping[str, object] | None = None) -> tuple[dict[str, object], list[str]]:
    """Settings and warnings about keys that aren't known. An output mode that isn't known means CSV; SARIF means relevant tests only unless all are asked for."""
    given = _yaml(text) if text else {}
    unknown = [f"unknown setting {k}" for k in given if k not in DEFAULTS and k != "includeNonSecurity"]
    out = DEFAULTS | {k: v for k, v in given.items() if k in DEFAULTS} | dict(arguments or {})
    if out["outputMode"] not in ("csv", "plain", "json", "sarif"):
        out["outputMode"] = "csv"
    if out["outputMode"] == "sarif" and not (given.get("includeNonSecurity") or out.pop("includeNonSecurity", False)):
        out["securityOnly"] = True
    return out, unknown


def suffixes_for(plugin: str, entries: Sequence[str]) -> list[str]:
    """Suffixes for a plug-in: entries without a prefix are for all, plugin:suffix for that one alone."""
    out = []
    for e in entries:
        name, colon, rest = e.partition(":")
        if not colon:
            out.append(e)
        elif name == plugin:
            out.append(rest)
    return out


def read_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, name, content) of regular files below a root whose name ends with a suffix; names are matched while files are listed."""
    glob = "{" + ",".join(f"*{s}" for s in suffixes) + "}" if suffixes else "*"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content"))
