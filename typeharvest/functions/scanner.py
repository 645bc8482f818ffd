"""Which characters of a file are code.

A file is read once, from left to right, with a stack of open strings and
interpolations, so nesting has no limit and cost is linear. The result has the
length of the text: token offsets hold for both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from typeharvest.shipping import ship

_CODE = re.compile(r"#=|#|\"\"\"|[\"`'()]")
_COMMENT = re.compile(r"#=|=#")
_CHAR = re.compile(r"'(?:\\[^']*(?:'(?=')|)|[^'\\])'")
_IN_STRING = {
    (closer, raw): re.compile(r"\\.|" + ("" if raw else r"\$\(|") + closer, re.S)
    for closer in ('"', '"""', "`") for raw in (False, True)
}
_NOT_NEWLINE = re.compile(r"[^\n]")
#: a lone quote is a token that no file with complete strings and comments has
_UNFINISHED = '"'


def _blank(text: str) -> str:
    return _NOT_NEWLINE.sub(" ", text)


def _literal(text: str, closer: str, raw: bool) -> str:
    """A string without interpolation; what the token patterns would misread is blanked."""
    body = text[len(closer):-len(closer)]
    if (closer == '"""' and ('"' in body or "\\" in body)) or "$(" in body or (raw and "\\" in body):
        return closer + _blank(body) + closer
    return text


def code_of(text: str) -> str:
    """The text with comments blanked and the code of interpolations laid bare.

    A string with interpolations becomes an empty string followed by the
    bracketed codes. A string or block comment without end leaves a lone quote.
    """
    if not any(c in text for c in '#"`'):
        return text
    out: list[str] = []
    # open strings: (closer, raw, whether an interpolation was met, brackets open in the code around)
    strings: list[tuple[str, bool, bool, int]] = []
    at, n, depth, in_code = 0, len(text), 0, True
    begin = 0  # of the open string, or of what follows its last interpolation
    while at < n:
        if in_code:
            m = _CODE.search(text, at)
            if m is None:
                out.append(text[at:])
                break
            found, start, end = m[0], m.start(), m.end()
            out.append(text[at:start])
            if found == "#=":
                level, end = 1, start + 2
                while level:
                    c = _COMMENT.search(text, end)
                    if c is None:
                        break
                    level += 1 if c[0] == "#=" else -1
                    end = c.end()
                if level:
                    out.append(_UNFINISHED + _blank(text[start + 1:]))
                    return "".join(out)
                out.append(_blank(text[start:end]))
            elif found == "#":
                end = text.find("\n", start)
                end = n if end < 0 else end
                out.append(" " * (end - start))
            elif found == "'":
                before = text[start - 1] if start else " "
                c = None if before.isalnum() or before in "_)]}'" else _CHAR.match(text, start)
                end = c.end() if c else end
                out.append(text[start:end])
            elif found in "()":
                out.append(found)
                if strings:
                    depth += 1 if found == "(" else -1
                    if depth == 0:
                        in_code, begin = False, end
            else:
                raw = start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")
                strings.append((found, raw, False, depth))
                in_code, begin = False, start
            at = end
            continue
        closer, raw, open_, around = strings[-1]
        m = _IN_STRING[closer, raw].search(text, at)
        if m is None:
            out.append(_UNFINISHED + " " * (n - begin - 1))
            return "".join(out)
        if m[0][0] == "\\":
            at = m.end()
        elif m[0] == "$(":
            gap = m.end() - 1 - begin
            out.append((" " * gap if open_ else '""' + " " * (gap - 2)) + "(")
            strings[-1] = (closer, raw, True, around)
            in_code, depth, at = True, 1, m.end()
        else:
            whole = text[begin:m.end()]
            out.append(" " * len(whole) if open_ else _literal(whole, closer, raw))
            strings.pop()
            in_code, depth, at = True, around, m.end()
    if strings:
        if not in_code:
            out.append(_UNFINISHED + " " * (n - begin - 1) if n > begin else "")
        return "".join(out)[:n]
    return "".join(out)


def code_only(files: DataFrame) -> DataFrame:
    """The files with their text replaced by its code; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("text")
            code = pa.array([None if t is None else code_of(t) for t in b.column(k).to_pylist()], pa.string())
            yield b.set_column(k, b.schema.field(k), code)

    ship(files.sparkSession)
    return files.mapInArrow(run, files.schema)


def cut(files: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span (pos, kind, start, stop) of a file, with its characters
    as ``snippet``; a file without any gives one row of nulls. Cost is linear in
    the file: its text is read once, whatever the number of spans."""
    keep = [f for f in files.schema.fields if f.name not in ("text", spans)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    schema += ", pos long, kind string, start long, stop long, snippet string"
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, (text, own) in enumerate(zip(b.column("text"), b.column(spans).to_pylist())):
                text = text.as_py()
                for s in own or ():
                    rows.append(i)
                    start, stop = s["start"] or 0, s["stop"] or 0  # an unreadable file may lack an end
                    found.append((s["pos"], s["kind"], start, stop, text[start:max(start, stop)].strip(" ")))
                if not own:
                    rows.append(i)
                    found.append((None,) * 5)
            kept = b.select(names).take(pa.array(rows, pa.int64()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(pa.array([f[j] for f in found], k) for j, k in enumerate(kinds))],
                names=[*names, "pos", "kind", "start", "stop", "snippet"])

    ship(files.sparkSession)
    return files.mapInArrow(run, schema)
