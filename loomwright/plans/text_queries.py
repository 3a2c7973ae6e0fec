"""Queries over texts: repair by policy, tags, blocks. Damage is put round the given whole texts first.

The DuckDB twins apply the same fixed patterns in the same order, each step a subquery of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import blocks as B
from loomwright.functions import text as X
from loomwright.plans.registry import query
from loomwright.session import spread

#: Unicode's white space, and what is cut off like a space, as RE2 classes.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LOW = r"[\x00-\x20]"


def _sub(x: str, pattern: str, to: str = "") -> str:
    """DuckDB's form of a replacement with Java's groups."""
    quoted = lambda t: t.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"regexp_replace({x}, '{quoted(pattern)}', '{quoted(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], to))}', 'g')"


def _strip(x: str, white: str = WHITE) -> str:
    return _sub(x, f"^{white}+|{white}+$")


def _steps(rows: str, *steps) -> str:
    """``rows`` (doc_id, x) with x put through each step: a form of x, what mends its lines outside of code
    (in a tuple), or what makes other rows (in a list)."""
    for step in steps:
        if isinstance(step, list):
            rows = step[0](rows)
        else:
            rows = _mended(rows, step[0]) if isinstance(step, tuple) else f"SELECT doc_id, {step('x')} AS x FROM ({rows})"
    return rows


def _mended(rows: str, mend) -> str:
    """Lines in a row each, a running count of fences before them, and the lines together again."""
    lines = f"SELECT doc_id, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM ({rows})"
    marked = f"SELECT *, starts_with({_strip('l', LOW)}, '```') AS fence FROM ({lines})"
    before = f"SELECT *, coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ({marked})"
    one = f"CASE WHEN fence OR n % 2 = 1 THEN l ELSE {mend('l')} END"
    return f"SELECT doc_id, ltrim(string_agg({one}, chr(10) ORDER BY i), chr(10)) AS x FROM ({before}) GROUP BY doc_id"


def _plain_blocks(rows: str) -> str:
    """Written form of documents that are nothing but headings with marks in front, lines of stars and paragraphs."""
    lines = f"SELECT doc_id, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM ({rows})"
    bare = f"SELECT doc_id, i, trim(raw, ' ' || chr(9)) AS l FROM ({lines})"
    heads = f"SELECT *, regexp_matches(l, '^#{{1,6}}([ \\t]|$)') AS head, regexp_matches(l, '^#{{1,6}}([ \\t]|$)|^([*][ \\t]*){{3,}}$') AS apart FROM ({bare}) WHERE l <> ''"
    title = _sub("l", r"^#{1,6}[ \t]*|[ \t]+#+$")
    level = f"CASE WHEN regexp_matches(l, '^##[ \t]') AND regexp_matches({title}, '^[0-9]+[.][0-9]+') THEN '###' ELSE regexp_extract(l, '^#+') END"
    gaps = "CASE WHEN lag(i) OVER w IS NULL THEN '' WHEN i - lag(i) OVER w > 1 OR apart OR lag(apart) OVER w THEN chr(10) || chr(10) ELSE chr(10) END"
    made = f"SELECT doc_id, i, {gaps} || CASE WHEN head THEN {level} || ' ' || {title} ELSE l END AS l FROM ({heads}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    return f"SELECT doc_id, string_agg(l, '' ORDER BY i) AS x FROM ({made}) GROUP BY doc_id"


UNESCAPE = (lambda line: _sub(line, X.ESCAPED, "$1"),)


def _without_chat(x: str) -> str:
    return _sub(_sub(x, X.CHATTY), X.OUTER_FENCE, "$1")


def _lines(x: str, *marks: str, split: str = "string_split({x}, chr(10))", drop: str = "''") -> str:
    one = _strip("l")
    for mark in marks:
        one = _sub(one, mark)
    return f"list_filter(list_transform({split.format(x=x)}, lambda l: {_strip(one)}), lambda l: l NOT IN ({drop}))"


PLAIN = [_without_chat, lambda x: f"array_to_string({_lines(x, X.HEADING_MARK, X.BULLET_MARK, X.NUMBER_MARK, drop=', '.join(repr(h) for h in ('', *X.PLAIN_HEADINGS)))}, chr(10))"]
FEW_LINES = [_without_chat, lambda x: f"array_to_string({_lines(x, X.BULLET_MARK, X.NUMBER_MARK, X.HEADING_MARK)}[1:5], chr(10))"]
INLINE = [_without_chat, UNESCAPE, _strip]
REPAIRED = [UNESCAPE if rule is None else (lambda x, rule=rule: _sub(x, *rule)) for rule in X.MARKDOWN_REPAIRS]
LIGHT = [*REPAIRED, UNESCAPE, _strip]
STRICT = [*REPAIRED, [_plain_blocks], UNESCAPE, UNESCAPE]


def _raw(documents: DataFrame, *parts: str | Column) -> DataFrame:
    return spread(documents.select("doc_id", "text")).select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("raw"))


def _raw_sql(*parts: str) -> str:
    """The same; "text" stands for the column."""
    quoted = lambda p: "'" + p.replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT doc_id, {' || '.join(p if p == 'text' else quoted(p) for p in parts)} AS x FROM documents"


def _over_texts(name: str, parts: list[str], rule, steps) -> None:
    """Registers ``rule`` on each whole text between the given parts."""
    query(name, "documents", f"SELECT doc_id, x AS text FROM ({_steps(_raw_sql(*parts), *steps)})")(
        lambda d: _raw(d, *[F.col("text") if p == "text" else p for p in parts]).select("doc_id", rule(F.col("raw")).alias("text"))
    )


query("word_count", "documents", f"SELECT doc_id, CAST(coalesce(length({_strip('text', LOW)}), 0) AS INT) AS n FROM documents")(
    lambda d: d.select("doc_id", X.word_count(F.col("text")).alias("n"))
)
query("join_tags", "article_meta", "SELECT article_id, replace(replace(tags, ', ', ','), ' ', ',') AS tags FROM article_meta")(
    lambda m: m.select("article_id", X.join_tags(F.regexp_replace("tags", ",", "， ，、")).alias("tags"))
)
query("split_tags", "article_meta", "SELECT article_id, trim(unnest(string_split(tags, ','))) AS tag FROM article_meta")(
    lambda m: m.select("article_id", F.explode(X.split_tags(F.col("tags"))).alias("tag"))
)
query("tag_match", "article_meta", "SELECT article_id, list_has_any(string_split(lower(tags), ','), ['1-urgent', 'x']) AS hit FROM article_meta")(
    lambda m: m.select("article_id", X.tag_match(F.col("tags"), ["1-Urgent", "X"]).alias("hit"))
)
query("content_hash", "documents", "SELECT doc_id, md5(text) AS hash FROM documents")(lambda d: d.select("doc_id", X.content_hash(F.col("text")).alias("hash")))
query("format_time", "interaction", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM interaction")(
    lambda e: e.select("event_id", X.format_time(F.col("ts")).alias("at"))
)
query("policy_for_task", "ai_task", """
    SELECT id, CASE task_type WHEN 'POLISH_TEXT' THEN CASE WHEN id % 16 = 0 THEN 'INLINE_LIGHT' ELSE 'ARTICLE_STRICT' END
                    WHEN 'GENERATE_OUTLINE' THEN 'OUTLINE_LIGHT' WHEN 'SUMMARIZE' THEN 'PLAIN_TEXT' WHEN 'GENERATE_TITLE' THEN 'PLAIN_LINES' WHEN 'GENERATE_TAGS' THEN 'TAGS'
                    WHEN 'QUALITY_CHECK' THEN 'REPORT_LIGHT' WHEN 'GENERATE_BODY' THEN 'ARTICLE_STRICT' END AS policy FROM ai_task""")(
    lambda t: t.select("id", X.policy_for_task(F.col("task_type"), F.when(F.col("id") % 16 == 0, F.lit("x【处理范围】选中文本"))).alias("policy"))
)

LISTED = ["以下是结果：\n```md\n## 摘要\n- ", "text", "\n2) end\n```"]
ESCAPES = ["\\*\\*\n```x\n\\*a\n```\n\\- ", "text", "\\|\n```\n\\*b"]
GLUED = ["```markdown\n##2.1", "text", "##3.2b\n-c [粗体]<br/>end\n3\\. d\n| a |\n\n| b |\n```"]
_over_texts("normalize_plain_text", LISTED, X.normalize_plain_text, PLAIN)
_over_texts("normalize_plain_lines", LISTED, X.normalize_plain_lines, FEW_LINES)
_over_texts("unescape_outside_code", ESCAPES, X.unescape_outside_code, [UNESCAPE])
_over_texts("normalize_inline_light", ["下面是结果:\n", *ESCAPES, " "], X.normalize_inline_light, INLINE)
_over_texts("normalize_markdown_light", GLUED, X.normalize_markdown_light, LIGHT)


def _between(x: str) -> str:
    """The given text, as it stands between the repaired forms of FRAMED's parts."""
    before, after = (len(p.removeprefix("```markdown\n").removesuffix("\n```").replace(" [粗体]", "").replace("javaint", "java\nint").replace("<br/>", "\n")) for p in FRAMED[::2])
    return f"substr({x}, {before + 1}, length({x}) - {before + after})"


#: Headings underlined, in a quote and in a list stand round each text; the twin knows their written form.
FRAMED = ["```markdown\n> 2.1 q\n> ---\n> a\n\n2.2 s\n---\n", "text", "\n\n- 3.3 d [粗体]\n  ---\n- e<br/>f\n\n```javaint x;\n\\*c\n```\n```"]
WRITTEN = ["> ### 2.1 q\n> \n> a\n\n### 2.2 s\n\n", "\n\n- ### 3.3 d\n- e\n  f\n\n```java\nint x;\n\\*c\n```"]
_framed = lambda x: " || ".join(["'" + WRITTEN[0].replace("\n", "' || chr(10) || '") + "'", x, "'" + WRITTEN[1].replace("\n", "' || chr(10) || '") + "'"])
_over_texts("normalize_article_strict", FRAMED, X.normalize_article_strict, [*REPAIRED, _between, [_plain_blocks], UNESCAPE, UNESCAPE, _framed])

@query("normalize_tags", "article_meta", "SELECT article_id, tags FROM article_meta")
def _tags(meta):
    parts = F.split("tags", ", ")
    raw = F.concat(F.lit("#"), parts[0], F.lit("；\n* "), parts[1], F.lit("、"), parts[0])
    return meta.select("article_id", X.normalize_tags(raw).alias("tags"))



TAG_LIST = "regexp_split_to_array({x}, '[，,、;；' || chr(10) || ']')"
TAGS = [
    _without_chat,
    lambda x: _lines(x, X.BULLET_MARK, X.NUMBER_MARK, X.HASH_MARK, split=TAG_LIST),
    lambda x: f"array_to_string(list_filter({x}, lambda t, i: list_position({x}, t) = i)[1:5], ', ')",
]
#: Every policy, null (like ARTICLE_STRICT) included, by the remainder of the id; with the steps of its twin.
POLICIES = [("NONE", []), ("PLAIN_TEXT", PLAIN), ("PLAIN_LINES", FEW_LINES), ("TAGS", TAGS), ("INLINE_LIGHT", INLINE), ("OUTLINE_LIGHT", LIGHT), ("ARTICLE_LIGHT", LIGHT), ("REPORT_LIGHT", LIGHT), ("ARTICLE_STRICT", STRICT), (None, STRICT)]
BY_POLICY = " UNION ALL ".join(
    f"SELECT doc_id, x AS text FROM ({_steps('SELECT * FROM (' + _raw_sql('## ', 'text') + f') WHERE doc_id % {len(POLICIES)} = {k}', *steps)})" for k, (_, steps) in enumerate(POLICIES)
)


@query("normalize_by_policy", "documents", BY_POLICY)
def _policy(documents):
    names = F.array(*[F.lit(name).cast("string") for name, _ in POLICIES])
    policy = F.element_at(names, (F.col("doc_id") % len(POLICIES) + 1).cast("int"))
    return spread(documents.select("doc_id", "text")).select("doc_id", X.normalize_by_policy(F.concat(F.lit("## "), "text"), policy).alias("text"))


def _blocks(documents):
    heading = F.to_json(F.struct(F.lit("md_heading").alias("type"), (F.col("doc_id") % 9).cast("int").alias("level"), "text"))
    items = F.to_json(F.struct(F.lit("md_list").alias("type"), (F.col("doc_id") % 2 == 0).alias("ordered"), F.array(F.col("text"), F.lit("{b}")).alias("items")))
    return spread(documents.select("doc_id", "text")).select("doc_id", "text", heading.alias("heading"), items.alias("items"))


HEADING = f"repeat('#', least(greatest(CAST(doc_id % 9 AS INT), 1), 6)) || ' ' || {_strip('text')}"
ITEMS = f"CASE WHEN doc_id % 2 = 0 THEN '1. ' || {_strip('text')} || chr(10) || '2. {{b}}' ELSE '- ' || {_strip('text')} || chr(10) || '- {{b}}' END"
query("extract_json_objects", "documents", "SELECT doc_id, 2 AS objects, text AS heading FROM documents")(
    lambda d: _blocks(d)
    .select("doc_id", B.extract_json_objects(F.concat(F.lit("noise } "), "heading", F.lit(" x "), "items", F.lit(" { open"))).alias("o"))
    .select("doc_id", F.size("o").alias("objects"), F.get_json_object(F.col("o")[0], "$.text").alias("heading"))
)


@query("is_block_line", "documents", """
    WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN to_json({'type': 'md_' || lang, 'text': text})::VARCHAR WHEN 1 THEN to_json({'type': lang, 'text': text})::VARCHAR ELSE text END AS line FROM documents)
    SELECT doc_id, starts_with(trim(line), '{') AND ends_with(trim(line), '}')
           AND coalesce(starts_with(CASE WHEN json_valid(line) THEN json_extract_string(line, '$.type') END, 'md_'), false) AS is_block FROM l""")
def _is_block(documents):
    of = lambda kind: F.to_json(F.struct(kind.alias("type"), "text"))
    line = F.when(F.col("doc_id") % 3 == 0, of(F.concat(F.lit("md_"), "lang"))).when(F.col("doc_id") % 3 == 1, of(F.col("lang"))).otherwise(F.col("text"))
    return documents.select("doc_id", B.is_block_line(line).alias("is_block"))


query("render_block", "documents", f"SELECT doc_id, {HEADING} AS heading, {ITEMS} AS items FROM documents")(
    lambda d: _blocks(d).select("doc_id", B.render_block(F.col("heading")).alias("heading"), B.render_block(F.col("items")).alias("items"))
)
query("render_blocks_document", "documents", f"SELECT doc_id, {HEADING} || chr(10) || chr(10) || {ITEMS} AS text FROM documents")(
    lambda d: _blocks(d).select("doc_id", B.render_blocks_document(F.concat(F.lit("ok\n"), "heading", F.lit("\n\nand "), "items")).alias("text"))
)


@query("parse_illustrations", "documents", """
    SELECT doc_id, CAST(1 AS INT) AS pos, text AS anchor, lang AS "diagramType", source AS requirement FROM documents
    WHERE doc_id % 4 > 0 AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def _illustrations(documents):
    good = F.to_json(F.struct(F.col("text").alias("anchor"), F.col("lang").alias("diagramType"), F.col("source").alias("requirement")))
    lines = F.concat(F.lit("bad line\n"), good, F.lit('\n{"anchor":"only"}'), F.when(F.col("doc_id") % 4 == 0, '\n{"none":true}').otherwise(""))
    return B.parse_illustrations(documents.select("doc_id", lines.alias("output")))


@query("inject_block", "documents", f"""
    WITH d AS (SELECT doc_id, 'one ' || text || chr(10) || 'two' AS t, CASE doc_id % 3 WHEN 0 THEN right(text, 15) WHEN 1 THEN '  ' || right(text, 15) || ' ' ELSE '#' END AS a,
                      chr(10) || '```drawio' || chr(10) || 'x' || chr(10) || '```' || chr(10) AS f FROM documents),
         w AS (SELECT *, coalesce(list_reduce(list_prepend('', regexp_split_to_array(trim(a), '{LOW[:-1]}]+')), lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END), '') AS longest FROM d),
         p AS (SELECT *, CASE WHEN {_strip('a')} = '' THEN 0 WHEN strpos(t, a) > 0 THEN strpos(t, a) WHEN strpos(t, trim(a)) > 0 THEN strpos(t, trim(a))
                              WHEN length(longest) >= 3 THEN strpos(t, longest) ELSE 0 END AS found FROM w),
         c AS (SELECT *, strpos(substr(t, found + length(a)), chr(10)) AS line_end FROM p),
         k AS (SELECT *, CASE WHEN line_end > 0 THEN found + length(a) + line_end - 1 ELSE least(found + length(a), length(t) + 1) END AS cut FROM c)
    SELECT doc_id, CASE WHEN found > 0 THEN substr(t, 1, cut - 1) || chr(10) || f || substr(t, cut) ELSE t || chr(10) || f END AS text FROM k""")
def _inject(documents):
    last = F.expr("right(text, 15)")
    anchor = F.when(F.col("doc_id") % 3 == 0, last).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), last, F.lit(" "))).otherwise(F.lit("#"))
    return documents.select("doc_id", B.inject_block(F.concat(F.lit("one "), "text", F.lit("\ntwo")), anchor, F.lit("x")).alias("text"))
