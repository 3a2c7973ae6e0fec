"""String, tag and Markdown functions, Column to Column, inside the JVM but for the block tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.markdown import strict_document

#: Patterns and replacements that repair machine-written Markdown, in the order they apply
#: (fixed values: results depend on each one and on the order). None marks the place of the
#: removal of backslashes outside code fences.
MARKDOWN_REPAIRS: list[tuple[str, str] | None] = [
    (r"(?s)^```(?:markdown|md)\s*\n(.*)\n```\s*$", "$1"),
    None,
    (r"(?m)^(\s*)(\d+)\\\.", "$1$2."),
    (r"(?m)^(\d+\.)\s*\n+\s*([^\s\n#|>-])", "$1 $2"),
    (r"(?m)^(\s*[-*])([^\s\-*\n])", "$1 $2"),
    (r"(?m)([^\n#])(#{2,6})([^\s\n#])", "$1\n\n$2 $3"),
    (r"(?m)([^\n#])(#{2,6})\s", "$1\n\n$2 "),
    (r"(?m)^(#{1,5})\s+#\s+", "$1# "),
    (r"(?m)^(#{1,6})([^\s#\n])", "$1 $2"),
    (r"(?m)^(#{1,6}\s+[^\n]{2,60}?)(\*\*[^\n]+)$", "$1\n\n$2"),
    (r"(?m)^(#{1,6}\s+[^\n|]+)(\|[^\n]+\|)$", "$1\n\n$2"),
    (r"(?m)^(#{1,6}\s+\d+\.)\s*\n+\s*(\d+)", "$1$2"),
    (r"(?s)(\$\$?[^$]*?)\\_", "$1_"),
    (r"(?s)(\$\$?[^$]*?)\\=", "$1="),
    (r"\s*\[(?:粗体|列表|表格|引用)\]", ""),
    (r"(?m)(\|[^\n]+\|)\n\n(\|)", "$1\n$2"),
    (r"(?m)([^|\n\s][^\n]*)\n(\|[^\n]+\|\s*\n\|[-\s|]+\|)", "$1\n\n$2"),
    (r"(?i)<br\s*/?>", "\n"),
    (
        r"(?m)^(\s*```)(javascript|typescript|kotlin|python|properties|yaml|bash|shell|json|html|java|rust|yml|sql|xml|css|cpp|go|js|ts|py|sh|c)(\S.*)$",
        "$1$2\n$3",
    ),
]
#: The same for two of them whose search is quadratic in the length of a line or of a run of white
#: space: a match begins where the line (or the last match) does, or where the run does.
LINEAR = {
    r"(?m)([^|\n\s][^\n]*)\n(\|[^\n]+\|\s*\n\|[-\s|]+\|)": r"(?m)((?:^|\G)[|\s&&[^\n]]*+[^|\n\s][^\n]*+)\n(\|[^\n]+\|\s*\n\|[-\s|]+\|)",
    r"\s*\[(?:粗体|列表|表格|引用)\]": r"(?<!\s)\s*+\[(?:粗体|列表|表格|引用)\]",
}
#: Other fixed values: an outer fence, a chatty beginning, line markers, headings dropped from
#: plain text, the mark of a partial polish, and policies by task type.
OUTER_FENCE = r"(?s)^```(?:markdown|md)?\s*\n(.*)\n```\s*$"
CHATTY = r"(?s)^\s*(以下是|下面是|这是|为你生成的|根据.*?生成的)[^\n]*[:：]\s*"
HEADING_MARK, BULLET_MARK, NUMBER_MARK, HASH_MARK = r"^#{1,6}\s*", r"^[-*+]\s+", r"^\d+[.)、]\s*", r"^#+"
PLAIN_HEADINGS = ("摘要", "文章摘要", "总结")
SELECTED_TEXT = "【处理范围】选中文本"
POLICIES = {
    "GENERATE_OUTLINE": "OUTLINE_LIGHT",
    "SUMMARIZE": "PLAIN_TEXT",
    "GENERATE_TITLE": "PLAIN_LINES",
    "GENERATE_TAGS": "TAGS",
    "QUALITY_CHECK": "REPORT_LIGHT",
    "GENERATE_BODY": "ARTICLE_STRICT",
}
#: From a line whose first characters after white space and control characters are three backticks
#: up to the next one, or to the end. Possessive throughout, so that long parts need no stack.
FENCE_LINE = r"[\x00-\x20&&[^\n]]*+```"
FENCED = rf"(?md)^{FENCE_LINE}[^\n]*+(?:\n(?!{FENCE_LINE})[^\n]*+)*+(?:\n{FENCE_LINE}[^\n]*+)?+"
ESCAPED = r"\\([*#|\->.`])"
TAG_SPLIT_JOIN, TAG_SPLIT_NORMAL = r"[，,、\s]+", r"[，,、;；\n]"


def java_trim(text: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def word_count(text: Column) -> Column:
    return F.coalesce(F.length(java_trim(text)), F.lit(0))


def join_tags(tags: Column) -> Column:
    parts = F.filter(F.transform(F.split(tags, TAG_SPLIT_JOIN), java_trim), lambda t: F.length(t) > 0)
    return F.array_join(parts, ",")


def split_tags(tags: Column) -> Column:
    """The list of a stored tag string; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), java_trim)
    return F.filter(parts, lambda t: F.length(t) > 0)


def tag_match(tags: Column, wanted: list[str]) -> Column:
    """Whether a stored tag string holds any wanted tag, whatever the case."""
    return F.arrays_overlap(F.split(F.lower(F.coalesce(tags, F.lit(""))), ","), F.array(*[F.lit(w.lower()) for w in wanted]))


def content_hash(content: Column) -> Column:
    return F.md5(content)


def format_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescape_outside_code(text: Column) -> Column:
    """Backslashes before Markdown marks go, except within code fences (a fence line toggles). Empty
    lines at the beginning go. Linear: one pattern finds whole fenced parts, which stay, or a mark."""
    return F.regexp_replace(F.regexp_replace(text, f"({FENCED})|{ESCAPED}", "$1$2"), r"^\n+", "")


def without_chat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CHATTY, ""), OUTER_FENCE, "$1")


def _cleaned(line: Column, *marks: str) -> Column:
    out = strip(line)
    for mark in marks:
        out = F.regexp_replace(out, mark, "")
    return strip(out)


def normalize_plain_text(text: Column) -> Column:
    lines = F.transform(F.split(without_chat(text), "\n"), lambda x: _cleaned(x, HEADING_MARK, BULLET_MARK, NUMBER_MARK))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) > 0) & ~x.isin(*PLAIN_HEADINGS)), "\n")


def normalize_plain_lines(text: Column, most: int = 5) -> Column:
    lines = F.transform(F.split(without_chat(text), "\n"), lambda x: _cleaned(x, BULLET_MARK, NUMBER_MARK, HEADING_MARK))
    return F.array_join(F.slice(F.filter(lines, lambda x: F.length(x) > 0), 1, most), "\n")


def normalize_tags(text: Column, most: int = 5) -> Column:
    parts = F.transform(F.split(without_chat(text), TAG_SPLIT_NORMAL), lambda x: _cleaned(x, BULLET_MARK, NUMBER_MARK, HASH_MARK))
    return F.array_join(F.slice(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 0)), 1, most), ", ")


def normalize_inline_light(text: Column) -> Column:
    return strip(unescape_outside_code(without_chat(text)))


def repaired(text: Column) -> Column:
    for rule in MARKDOWN_REPAIRS:
        text = unescape_outside_code(text) if rule is None else F.regexp_replace(text, LINEAR.get(rule[0], rule[0]), rule[1])
    return text


def normalize_markdown_light(text: Column) -> Column:
    return strip(unescape_outside_code(repaired(text)))


def normalize_article_strict(text: Column) -> Column:
    """Light repair, then the document's block tree: numbered second-level headings ("2.1 ...") become
    third-level ones, whatever their form and the quote or list they stand in, and all blocks are
    written in one form (``functions.markdown``). Backslashes before marks go, but not within fences."""
    return strict_document(repaired(text))


def policy_for_task(task_type: Column, payload: Column) -> Column:
    out = F.when(task_type == "POLISH_TEXT", F.when(F.contains(F.coalesce(payload, F.lit("")), F.lit(SELECTED_TEXT)), "INLINE_LIGHT").otherwise("ARTICLE_STRICT"))
    for name, policy in POLICIES.items():
        out = F.when(task_type == name, policy).otherwise(out)
    return out


def normalize_by_policy(text: Column, policy: Column) -> Column:
    """Text by the policy of its row: NONE as it is, null like ARTICLE_STRICT. Blank text stays."""
    rule = F.coalesce(policy, F.lit("ARTICLE_STRICT"))
    return (
        F.when(is_blank(text) | (rule == "NONE"), text)
        .when(rule == "PLAIN_TEXT", normalize_plain_text(text))
        .when(rule == "PLAIN_LINES", normalize_plain_lines(text))
        .when(rule == "TAGS", normalize_tags(text))
        .when(rule == "INLINE_LIGHT", normalize_inline_light(text))
        .when(rule.isin("OUTLINE_LIGHT", "ARTICLE_LIGHT", "REPORT_LIGHT"), normalize_markdown_light(text))
        .otherwise(normalize_article_strict(text))
    )
