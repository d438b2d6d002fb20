"""Tokens of JavaScript and TypeScript texts as a table, with the brackets that enclose them.

One row per token. Brackets make a tree: the tokens between an opening bracket and its partner are its box, and a bracket
stands for its whole box among its neighbours. So a declaration is a short run of neighbours in one box, however its text
is broken into lines, and all that follows is windows over neighbours and patterns over their texts. Boxes and neighbours never
leave a file, so a task finds them for its files by columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetline.operators.staging import materialise
from facetline.sources.token_boxes import SCHEMA, placed

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
_STRING = r"""\"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'"""
_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*`"
# a slash begins a pattern where no value stands before it; what stands before is looked at only where the mark itself stands
_PATTERN = r"(?=/)(?<=[=(,:;!&|?{\[\n+]\s{0,40}|=>\s{0,40}|\breturn\s{1,9}|^\s{0,40})/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_MARKS = r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|[=!]==?|[<>]=|&&=?|\|\|=?|\*\*=?|\+\+|--|[-+*/%&|^]="
# elements: an angle bracket with its name, as no space comes between them but one before, if a value stands there
_TAG = rf"(?=<)(?<=[\s(>{{}}\[,=?:&|;!]|^)</?(?:{NAME}(?:[.:-]{NAME})*)?(?=[\s/>])"
TOKEN = rf"{_COMMENT}|{_STRING}|{_TEMPLATE}|{_PATTERN}|{_TAG}|[#@]?{NAME}|\d[\w.]*|{_MARKS}|\n|[^\s]"

#: Characters of texts of a task, some 50 bytes of rows each.
TASK_CHARS = 4_000_000


def _template(token: Column) -> Column:
    """A template as the marks of a box around what it puts in; one that puts in nothing stays whole."""
    inner = F.regexp_extract_all(token, F.lit(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1))
    code = F.array_join(inner, " ; ")
    # lines after the template keep their numbers
    lost = F.length(F.regexp_replace(token, r"[^\n]", "")) - F.length(F.regexp_replace(code, r"[^\n]", ""))
    opened = F.concat(F.array(F.lit("`(")), F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), F.array_repeat(F.lit("\n"), lost.cast("int")), F.array(F.lit("`)")))
    return F.when(F.startswith(token, F.lit("`")) & (F.size(inner) > 0), opened).otherwise(F.array(token))


def dealt(files: DataFrame) -> DataFrame:
    """The files (path, content) that have content, dealt by path to tasks of ``TASK_CHARS`` characters, so that the texts are shuffled once
    and their tokens, windows over a file and its boxes included, not at all."""
    held = files.where("content IS NOT NULL").select("path", "content")
    chars = held.agg(F.sum(F.length("content"))).first()[0] or 0
    return held.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "path")


def texts(files: DataFrame) -> DataFrame:
    """path, ts: the texts of all tokens of each file (path, content) in their order, a table in the shared folder; files without content are absent."""
    cut = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)), _template))
    return materialise(dealt(files).select("path", cut.alias("ts")), "token-texts")


def tokens(files: DataFrame) -> DataFrame:
    """The ``placed_tokens`` of files (path, content)."""
    return placed_tokens(texts(files))


def placed_tokens(held: DataFrame) -> DataFrame:
    """One row per token of each file (path, ts), a table in the shared folder.

    path; k: place in the file; line, last: lines on which it begins and, with its box, ends; t: text; w: text in patterns (a string is
    ``"``, a pattern ``/``, a number ``0``); kind: name, word (reserved), string, number, pattern, tag (an angle bracket with an element's name), mark;
    box: place of the bracket around it, -1 at the top; close: place of a bracket's partner; prev, prev2, next, next2: w of its neighbours
    in the box; prev_k, next_k: their places; prev_kind; stmt, item: numbers of its statement in the box, and of its part between commas;
    in_tag, in_text: whether it is an attribute's name or a text of an element.
    """
    return materialise(held.mapInArrow(placed, SCHEMA), "tokens")
