"""Text of simple PDF files, by the standard library alone.

It reads what most text-only writers make: objects, also in compressed object streams; Flate,
ASCII-hex and plain streams; the page tree; strings shown by the text operators, decoded by a font's
ToUnicode map or else as Latin text. Encrypted files, other filters and fonts without a map of their
glyphs are not read: these raise, or give no text. Tables are not recognised.
"""

from __future__ import annotations

import re
import zlib

#: What parts PDF has, as its specification writes them.
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()%]*|[^\s/<>\[\]()%]+|%[^\r\n]*", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(body: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r", b"\r\n") else ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, body, flags=re.DOTALL)


def _string(token: bytes) -> bytes:
    if token[:1] == b"(":
        return _unescaped(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Document:
    """The objects of a file, the newest of each number, as their bytes."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d", data):
            raise ValueError("an encrypted file")
        self.objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                content, first = self.stream(body), int(self.value(body, b"First"))
                heads = list(map(int, content[:first].split()))
                for (number, at), (_, end) in zip(zip(heads[::2], heads[1::2], strict=True), [*zip(heads[2::2], heads[3::2], strict=True), (0, len(content) - first)], strict=True):
                    self.objects.setdefault(number, content[first + at : first + end])

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands behind a name, references followed; empty if nothing does."""
        head = body.split(b"stream", 1)[0]
        found = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*(\d+\s+\d+\s+R|\[[^\]]*\]|<<(?:[^<>]|<[^<]|<<(?:[^<>]|<[^<])*>>)*>>|/?[^\s/<>\[\]]+)", head)
        if not found:
            return b""
        link = re.fullmatch(rb"(\d+)\s+\d+\s+R", found[1])
        return self.objects.get(int(link[1]), b"").strip() if link else found[1]

    def links(self, value: bytes) -> list[int]:
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", value)]

    def stream(self, body: bytes) -> bytes:
        found = STREAM.search(body)
        if not found:
            return b""
        data = found[1]
        for name in re.findall(rb"/(\w+)", self.value(body, b"Filter")):
            if name in (b"FlateDecode", b"Fl"):
                data = zlib.decompressobj().decompress(data)
            elif name in (b"ASCIIHexDecode", b"AHx"):
                data = _string(b"<" + data.split(b">")[0] + b">")
            else:
                raise ValueError(f"filter {name.decode()} is not read")
        return data

    def pages(self) -> list[bytes]:
        """The pages in the order of the tree that the catalogue names."""
        top = next((self.value(b, b"Pages") for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out, todo, seen = [], [top], 0
        while todo:
            node, seen = todo.pop(), seen + 1
            if seen > 10 * len(self.objects) + 10:
                raise ValueError("a page tree that has a circle")
            if kids := self.value(node, b"Kids"):
                todo += [self.objects.get(n, b"") for n in reversed(self.links(kids))]
            elif node:
                out.append(node)
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """By name, the ToUnicode map of each font of a page; empty for one without."""
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(self.value(page, b"Resources") or page, b"Font")):
            shown = self.value(self.objects.get(int(number), b""), b"ToUnicode")
            found[name] = _glyphs(self.stream(shown)) if shown else {}
        return found

    def text(self, page: bytes) -> str:
        content = self.value(page, b"Contents")
        parts = self.links(content) if content.startswith(b"[") else None
        data = b"\n".join(self.stream(self.objects.get(n, b"")) for n in parts) if parts is not None else self.stream(content)
        return shown(data, self.fonts(page))


def _glyphs(cmap: bytes) -> dict[bytes, str]:
    """Codes and their text of a ToUnicode map."""
    out, said = {}, lambda x: _string(x).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        tokens = re.findall(rb"<[0-9A-Fa-f\s]*>", block)
        out |= {_string(a): said(b) for a, b in zip(tokens[::2], tokens[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for low, high, to in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)\s*(<[^>]*>|\[[^\]]*\])", block):
            first, last, width = int.from_bytes(_string(low)), int.from_bytes(_string(high)), len(_string(low))
            if to.startswith(b"["):
                texts = [said(t) for t in re.findall(rb"<[^>]*>", to)]
            else:
                start = said(to)
                texts = [start[:-1] + chr(ord(start[-1]) + k) for k in range(min(last - first, 65535) + 1)] if start else []
            out |= {(first + k).to_bytes(width): t for k, t in enumerate(texts)}
    return out


def shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's operators show: a line feed where the line moves, a space where a wide gap is left within one."""
    out: list[str] = []
    glyphs: dict[bytes, str] = {}
    stack: list[bytes] = []

    def say(data: bytes) -> None:
        if not glyphs:
            out.append(data.decode("cp1252", "replace"))
            return
        width = max(map(len, glyphs))
        out.extend(glyphs.get(data[k : k + width], "") for k in range(0, len(data), width))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or token[:1].isdigit() or token[:1] in b"+-.":
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) > 1:
            glyphs = fonts.get(stack[-2][1:], {})
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and stack and float(stack[-1]) != 0) or token == b"Tm":
            line()
        elif token in (b"'", b'"'):
            line()
            say(_string(stack[-1]))
        elif token == b"Tj" and stack:
            say(_string(stack[-1]))
        elif token == b"TJ":
            begin = len(stack) - 1 - stack[::-1].index(b"[") if b"[" in stack else 0
            for x in stack[begin:]:
                if x[:1] in b"(<" and x != b"<<":
                    say(_string(x))
                elif x[:1] in b"-+.0123456789" and float(x) < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        if token[:1] != b"%":
            stack.clear()
    return "".join(out).strip("\n")


def parse(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """(pages' texts with a blank line between them, no tables), as a PDF backend of ``parsers.parsed``."""
    whole = Document(content)
    return "\n\n".join(whole.text(p) for p in whole.pages()), []
