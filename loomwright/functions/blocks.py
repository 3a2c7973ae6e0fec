"""JSON blocks of machine-written documents: found by balanced braces, rendered as Markdown."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.markdown import in_slices
from loomwright.functions.text import bound, is_blank, strip

BLOCK = "type string, text string, level int, ordered boolean, items array<string>, headers array<string>, rows array<array<string>>, lang string"


#: Outside of an object: its beginning. Inside: a brace, or a whole string (an open one reaches to the end).
OPENING = re.compile(r"\{")
INSIDE = re.compile(r'[{}]|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.DOTALL)


def objects_in(text: str | None) -> list[str]:
    """The top-level {...} of a text; braces within JSON strings don't count, an open end is dropped."""
    found, at = [], 0
    while text and (begin := OPENING.search(text, at)):
        depth, at = 1, begin.end()
        while depth:
            mark = INSIDE.search(text, at)
            if mark is None:
                return found
            at = mark.end()
            depth += {"{": 1, "}": -1}.get(mark[0], 0)
        found.append(text[begin.start() : at])
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def extract_json_objects(text: pa.Array) -> pa.Array:
    return in_slices(text, objects_in, pa.list_(pa.string()))


def is_block_line(line: Column) -> Column:
    trimmed = F.trim(F.coalesce(line, F.lit("")))
    kind = F.get_json_object(trimmed, "$.type")
    return trimmed.startswith("{") & trimmed.endswith("}") & F.coalesce(kind.startswith("md_"), F.lit(False))


def render_block(line: Column) -> Column:
    """Markdown of one block; null for other text and unknown blocks. JSON is parsed once a line."""
    return bound(F.from_json(F.trim(line), BLOCK), _rendered)


def _rendered(b: Column) -> Column:
    text = strip(F.coalesce(b["text"], F.lit("")))
    level = F.least(F.greatest(F.coalesce(b["level"], F.lit(2)), F.lit(1)), F.lit(6))
    empty = F.array().cast("array<string>")
    value = lambda x: F.coalesce(x, F.lit(""))
    numbered = F.transform(F.coalesce(b["items"], empty), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(value(x))))
    dotted = F.transform(F.coalesce(b["items"], empty), lambda x: F.concat(F.lit("- "), strip(value(x))))
    cell = lambda x: strip(F.replace(F.replace(value(x), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    width = F.size(b["headers"])
    line_of = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    row = lambda r: line_of(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    body = F.transform(F.coalesce(b["rows"], F.array().cast("array<array<string>>")), row)
    grid = F.array_join(F.concat(F.array(line_of(F.transform(b["headers"], cell)), rule), body), "\n")
    code = F.concat(F.lit("```"), strip(value(b["lang"])), F.lit("\n"), F.regexp_replace(value(b["text"]), r"(?U)\s+$", ""), F.lit("\n```"))
    kind = b["type"]
    return (
        F.when(kind == "md_heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind == "md_paragraph", text)
        .when(kind == "md_list", F.array_join(F.when(b["ordered"], numbered).otherwise(dotted), "\n"))
        .when(kind == "md_table", F.when(F.coalesce(width, F.lit(0)) > 0, grid).otherwise(""))
        .when(kind == "md_code", code)
        .when(kind == "md_quote", F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
        .when(kind == "md_divider", "---")
        .when(kind == "md_done", "")
    )


def render_blocks_document(raw: Column) -> Column:
    """The document of all blocks in a raw text, a blank line between; stripped raw text if it holds no object."""
    objects = F.transform(extract_json_objects(raw), lambda o: F.regexp_replace(o, r"[\r\n]", ""))
    parts = F.filter(F.transform(F.filter(objects, is_block_line), render_block), lambda x: F.length(x) > 0)
    return F.when(F.size(objects) == 0, strip(raw)).otherwise(F.array_join(parts, "\n\n"))


def parse_illustrations(outputs: DataFrame) -> DataFrame:
    """(doc_id, pos, anchor, diagramType, requirement) from (doc_id, output) of JSON lines. A line with
    none = true empties the whole document; lines that lack a field or aren't JSON are skipped."""
    fields = "none boolean, anchor string, diagramType string, requirement string"
    lines = outputs.select("doc_id", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    parsed = lines.select("doc_id", "pos", F.from_json(F.trim("line"), fields).alias("j")).select("doc_id", "pos", "j.*")
    cleared = F.max(F.coalesce("none", F.lit(False))).over(W.partitionBy("doc_id"))
    full = F.col("anchor").isNotNull() & F.col("diagramType").isNotNull() & F.col("requirement").isNotNull()
    return parsed.withColumn("cleared", cleared).where(~F.col("cleared") & full).select("doc_id", "pos", "anchor", "diagramType", "requirement")


def inject_block(text: Column, anchor: Column, block: Column) -> Column:
    """``text`` with a fenced block after the line that holds the anchor: as it is, trimmed, or by its
    longest word of three letters or more; at the end if none is found."""
    words = F.split(F.trim(anchor), r"\s+")
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    find = lambda needle: F.position(needle, text)
    found = F.when(is_blank(anchor), 0).when(find(anchor) > 0, find(anchor)).when(find(F.trim(anchor)) > 0, find(F.trim(anchor)))
    found = F.coalesce(found.otherwise(F.when(F.length(longest) >= 3, find(longest)).otherwise(0)), F.lit(0))
    after = found + F.length(anchor)
    fenced = F.concat(F.lit("\n```drawio\n"), block, F.lit("\n```\n"))
    line_end = F.position(F.lit("\n"), text, after)
    cut = F.when(line_end > 0, line_end).otherwise(F.least(after, F.length(text) + 1))
    head, tail = F.substring(text, F.lit(1), cut - 1), F.substring(text, cut, F.length(text))
    return F.when(found > 0, F.concat(head, F.lit("\n"), fenced, tail)).otherwise(F.concat(text, F.lit("\n"), fenced))
