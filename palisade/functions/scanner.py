"""Comments, strings and templates of JavaScript by a pushdown scanner, not a parser.

It walks over the tokens that matter with a stack of what is open: brackets, and templates with the code in them, to any depth.
Whether a slash begins a regular expression or divides follows from the token before it, and for brackets from what they
closed. What doesn't balance (an open string, comment, template or bracket at the end, a stray closing one) makes the source
incomplete: then nobody can say what is code, so hits in it count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What matters in code: words and numbers, quotes, comments, brackets, two operators, and any other sign.
_CODE = re.compile(r"[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*|\d[\w.]*|//[^\n\r  ]*|/\*|=>|\+\+|--|[^\s\w]")
_STRING = {q: re.compile(rf"(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*{q}") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
#: Words after which an operand comes, and words whose brackets are followed by a statement.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_HEADS = frozenset("if while for with".split())
_BLOCK_AFTER = frozenset([None, ";", "{", "}", ")", "=>", "else", "do", "try", "finally"])
_CLOSES = {")": "(", "]": "[", "}": "{"}


def scan(text: str) -> tuple[list[tuple[int, int]], bool]:
    """(start, end) of comments, strings and outermost templates, in order, and whether the source is incomplete."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple] = []  # (opening sign, whether a statement may follow its end, where a template began)
    at, before, operand, broken, depth = 0, None, True, False, 0  # depth: open templates; operand: whether a slash begins one

    def span(start: int, end: int) -> None:
        if not depth:
            spans.append((start, end))

    def template(start: int, at: int) -> int:
        """Goes on in a template from `at`; gives where code goes on."""
        nonlocal depth, broken, before, operand
        m = _TEMPLATE.match(text, at)
        if not m:
            broken = True
            depth -= 1
            span(start, len(text))
            return len(text)
        if m[1] == "${":
            stack.append(("${", False, start))
            before, operand = "(", True
        else:
            depth -= 1
            span(start, m.end())
            before, operand = "`", False
        return m.end()

    while m := _CODE.search(text, at):
        token, start, at = m[0], m.start(), m.end()
        head = token[0]
        if token == "/*":
            end = text.find("*/", at)
            broken, at = broken or end < 0, end + 2 if end >= 0 else len(text)
            span(start, at)
            continue
        if token.startswith("//"):
            span(start, at)
            continue
        if head in "\"'":
            string = _STRING[head].match(text, at)
            if string:
                at = string.end()
                span(start, at)
            else:
                broken = True
                at = min((i for i in (text.find("\n", at), text.find("\r", at)) if i >= 0), default=len(text))
            before, operand = '"', False
            continue
        if head == "`":
            depth += 1
            at = template(start, at)
            continue
        if head == "/" and operand and (literal := _REGEX.match(text, start)):
            at, before, operand = literal.end(), '"', False
            continue
        if head in "([{":
            # After a bracket's end: a statement (so an operand) after if (..) and after a block, an operator after others.
            follows = before in _HEADS if head == "(" else head == "{" and before in _BLOCK_AFTER
            stack.append((head, follows, None))
            before, operand = head, True
            continue
        if head in ")]}":
            if head == "}" and stack and stack[-1][0] == "${":
                at = template(stack.pop()[2], at)
            elif stack and stack[-1][0] == _CLOSES[head]:
                operand = stack.pop()[1]
                before = head
            else:
                broken, before, operand = True, head, False
            continue
        word = head.isalnum() or head in "_$" or head >= "\u0080"
        operand = token in _BEFORE_OPERAND if word else operand if token in ("++", "--") else True
        before = token
    return sorted(spans), broken or bool(stack)


SCANNED = "struct<spans:array<struct<start:int,end:int>>,incomplete:boolean>"
_SCANNED = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("incomplete", pa.bool_())])


def scanned(text: Column) -> Column:
    """struct(spans, incomplete) of a source, in code points; null for null. One Arrow pass."""

    @F.arrow_udf(SCANNED)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for source in batch:
                found = scan(source.as_py()) if source.is_valid else None
                out.append(found and {"spans": [{"start": a, "end": b} for a, b in found[0]], "incomplete": found[1]})
            yield pa.array(out, _SCANNED)

    return of(text)


def inside(js: Column, at: Column) -> Column:
    """Whether the (0-based) place lies in a comment, string or template of a complete source; js: of scanned."""
    return F.coalesce(~js["incomplete"] & F.exists(js["spans"], lambda t: (at >= t["start"]) & (at < t["end"])), F.lit(False))
