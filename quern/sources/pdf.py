"""Lines of plain PDF files: a small reader for text that is drawn by simple fonts.

It reads flate-coded and plain streams, object streams, and text of single-byte
fonts (by their ToUnicode table where there is one, else Latin-1). A reader for more
kinds of files is a function of the same form, given to page_lines().
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: A reader takes a file's bytes and returns (page, line, text, size, bold) from 0 on.
Reader = Callable[[bytes], list[tuple[int, int, str, float, bool]]]

TOKEN = re.compile(rb"%[^\r\n]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def string(token: bytes) -> bytes:
    """The bytes of a string in parentheses or of hexadecimal digits."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r") else ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.DOTALL)


class File:
    """The objects of a file: bodies by number, and the data of their streams."""

    def __init__(self, data: bytes) -> None:
        self.bodies: dict[int, bytes] = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.DOTALL)}
        for body in list(self.bodies.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                inner = self.stream(body)
                count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
                numbers = list(map(int, inner[:first].split()))[: 2 * count]
                starts = [first + x for x in numbers[1::2]] + [len(inner)]
                for number, a, b in zip(numbers[::2], starts, starts[1:], strict=False):
                    self.bodies.setdefault(number, inner[a:b])

    def stream(self, body: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.DOTALL)
        data = found[1] if found else b""
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in body.split(b"stream")[0] else data

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands after a name of a dictionary, followed where it is a reference."""
        found = re.search(rb"/%s\b\s*(\d+)\s+\d+\s+R" % name, body)
        if found:
            return self.bodies.get(int(found[1]), b"")
        found = re.search(rb"/%s\b\s*(<<.*|\[[^\]]*\]|/[^\s/<>\[\]]+|[^\s/<>\[\]][^/<>\[\]]*)" % name, body, re.DOTALL)
        return found[1] if found else b""

    def pages(self) -> list[bytes]:
        """Bodies of the pages in order, by the tree from the catalog; without one by number."""
        root = next((b for b in self.bodies.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        out: list[bytes] = []

        def walk(body: bytes, depth: int) -> None:
            if depth > 50:
                return
            if re.search(rb"/Type\s*/Pages\b", body):
                for number in re.findall(rb"(\d+)\s+\d+\s+R", self.value(body, b"Kids")):
                    walk(self.bodies.get(int(number), b""), depth + 1)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)

        if root is not None:
            walk(self.value(root, b"Pages"), 0)
        return out or [b for _, b in sorted(self.bodies.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, tuple[bool, dict[int, str]]]:
        """For each font's name on a page whether it is bold, and its table of characters."""
        resources = self.value(page, b"Resources") or page
        out = {}
        for name, number in re.findall(rb"/(\w+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            body, table = self.bodies.get(int(number), b""), {}
            for line in re.findall(rb"beginbfchar(.*?)endbfchar", self.stream(self.value(body, b"ToUnicode")), re.DOTALL):
                for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", line):
                    table[int(code, 16)] = bytes.fromhex(text.decode()).decode("utf-16-be", "replace")
            out[b"/" + name] = (b"bold" in self.value(body, b"BaseFont").lower(), table)
        return out

    def content(self, page: bytes) -> bytes:
        numbers = re.search(rb"/Contents\b\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", page)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", (numbers[1] or numbers[2]) if numbers else b"")
        return b"\n".join(self.stream(self.bodies.get(int(x), b"")) for x in refs)


def spans(content: bytes, fonts: dict[bytes, tuple[bool, dict[int, str]]]) -> list[tuple[float, float, str, float, bool]]:
    """(y, x, text, size, bold) of each piece of text that is drawn."""
    out, stack = [], []
    font, size, leading, x, y, scale, start = b"", 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
    number = lambda t: float(t) if re.fullmatch(rb"[+-]?\d*\.?\d+|[+-]?\d+\.", t) else 0.0

    def show(tokens: list[bytes]) -> None:
        nonlocal x
        bold, table = fonts.get(font, (False, {}))
        text = ""
        for t in tokens:
            if t[:1] in b"(<" and t != b"<<":
                text += "".join(table.get(c, chr(c)) for c in string(t))
            elif number(t) < -200:
                text += " "
        if text:
            out.append((y, x, text, size * scale, bold))
            x += size * scale * len(text) / 2

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/%" or re.fullmatch(rb"[+-]?\d*\.?\d+|[+-]?\d+\.", token):
            if token[:1] != b"%":
                stack.append(token)
            continue
        n = [number(t) for t in stack[-6:]]
        if token == b"BT":
            x = y = start = 0.0
            scale = 1.0
        elif token == b"Tf" and len(stack) > 1:
            font, size = stack[-2], n[-1]
        elif token == b"TL" and n:
            leading = n[-1]
        elif token in (b"Td", b"TD") and len(n) > 1:
            start, y = start + n[-2] * scale, y + n[-1] * scale
            x, leading = start, -n[-1] if token == b"TD" else leading
        elif token == b"Tm" and len(n) > 5:
            scale, start, y = abs(n[3]) or 1.0, n[4], n[5]
            x = start
        elif token in (b"T*", b"'", b'"'):
            y, x = y - leading * scale, start
        if token in (b"Tj", b"TJ", b"'", b'"'):
            show([t for t in stack if t not in (b"[", b"]")])
        stack.clear()
    return out


def read_lines(data: bytes) -> list[tuple[int, int, str, float, bool]]:
    """Lines from the top of each page down: pieces of about one height are one line, from left to right; its size and weight are the largest of them."""
    out, file = [], File(data)
    for page_number, page in enumerate(file.pages()):
        lines: list[list[tuple]] = []
        for piece in sorted(spans(file.content(page), file.fonts(page)), key=lambda s: (-s[0], s[1])):
            if lines and abs(lines[-1][0][0] - piece[0]) <= 2:
                lines[-1].append(piece)
            else:
                lines.append([piece])
        texts = [(" ".join(" ".join(s[2] for s in sorted(x, key=lambda s: s[1])).split()), max(s[3] for s in x), any(s[4] for s in x)) for x in lines]
        out += [(page_number, i, *t) for i, t in enumerate(t for t in texts if t[0])]
    return out


def page_lines(files: DataFrame, *, doc: str = "doc", content: str = "content", reader: Reader = read_lines) -> DataFrame:
    """doc, page, line, text, size, bold of PDF files (doc, content), as extraction.line_sections() wants them.

    A file that can't be read, or is none, has no lines. Files are read where they are, one after the other.
    """

    def work(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["__doc"], pdf["__content"], strict=True):
                try:
                    rows += [(name, *x) for x in reader(bytes(data))] if data is not None else []
                except (ValueError, IndexError, KeyError, TypeError, zlib.error, RecursionError):  # a broken file
                    continue
            yield pd.DataFrame(rows, columns=[doc, "page", "line", "text", "size", "bold"])

    named = files.selectExpr(f"`{doc}` as __doc", f"`{content}` as __content")
    return named.mapInPandas(work, f"`{doc}` {files.schema[doc].dataType.simpleString()}, page long, line long, text string, size double, bold boolean")
