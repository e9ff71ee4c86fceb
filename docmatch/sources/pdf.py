"""Page count and Info dictionary of PDF files, from their object structure alone."""

from __future__ import annotations

import re
import zlib

PDF = "struct<page_count:int,info:array<struct<key:string,value:string>>,error:string>"
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
DELIMITERS = b"()<>[]{}/% \t\r\n\f\0"


class PdfError(ValueError):
    """A file without the structure that is looked for."""


class _Reader:
    """Parses one object's text into Python values: names as "/X", references as
    ("ref", n), strings as bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _space(self) -> None:
        m = re.compile(rb"(?:[ \t\r\n\f\0]|%[^\r\n]*)*").match(self.data, self.at)
        self.at = m.end()

    def value(self):
        self._space()
        d, i = self.data, self.at
        if d.startswith(b"<<", i):
            self.at += 2
            out = {}
            while True:
                self._space()
                if self.data.startswith(b">>", self.at) or self.at >= len(d):
                    self.at += 2
                    return out
                key = self.value()
                out[key if isinstance(key, str) else repr(key)] = self.value()
        c = d[i : i + 1]
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self._space()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value())
        if c == b"/":
            m = re.compile(rb"/([^()<>\[\]{}/% \t\r\n\f\0]*)").match(d, i)
            self.at = m.end()
            return "/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]).decode("utf-8", "replace")
        if c == b"(":
            return self._literal()
        if c == b"<":
            m = re.compile(rb"<([0-9A-Fa-f\s]*)>").match(d, i)
            if not m:
                self.at += 1
                return None
            self.at = m.end()
            h = re.sub(rb"\s", b"", m[1])
            return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        m = re.compile(rb"(\d+)\s+(\d+)\s+R\b").match(d, i)
        if m:
            self.at = m.end()
            return ("ref", int(m[1]))
        m = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)").match(d, i)
        if m:
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        m = re.compile(rb"[A-Za-z]+").match(d, i)
        if m:
            self.at = m.end()
            return {b"true": True, b"false": False}.get(m[0])
        self.at += 1
        return None

    def _literal(self) -> bytes:
        out, depth, i, d = bytearray(), 0, self.at, self.data
        plain = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
        while i < len(d):
            c = d[i]
            if c == 92 and i + 1 < len(d):
                n = d[i + 1]
                m = re.compile(rb"[0-7]{1,3}").match(d, i + 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if n not in (10, 13):
                    out.append(plain.get(n, n))
                i += 2
                continue
            if c == 40:
                depth += 1
                if depth == 1:
                    i += 1
                    continue
            elif c == 41:
                depth -= 1
                if not depth:
                    i += 1
                    break
            out.append(c)
            i += 1
        self.at = i
        return bytes(out)


def _objects(body: bytes) -> dict[int, object]:
    found: dict[int, object] = {}
    packed = []
    for m in OBJECT.finditer(body):
        value = _Reader(m[3]).value()
        found[int(m[1])] = value
        if isinstance(value, dict) and value.get("/Type") == "/ObjStm" and (s := STREAM.search(m[3])):
            packed.append((value, s[1]))
    for head, data in packed:
        if head.get("/Filter") in ("/FlateDecode", ["/FlateDecode"]):
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif "/Filter" in head:
            continue
        first, n = head.get("/First"), head.get("/N")
        if not isinstance(first, int) or not isinstance(n, int):
            continue
        numbers = [int(x) for x in data[:first].split()[: 2 * n]]
        for number, at in zip(numbers[::2], numbers[1::2], strict=False):
            found.setdefault(number, _Reader(data, first + at).value())
    return found


def _text(value, objects: dict[int, object]) -> str:
    for _ in range(32):
        if not (isinstance(value, tuple) and value[0] == "ref"):
            break
        value = objects.get(value[1])
    if isinstance(value, bytes):
        if value[:2] == b"\xfe\xff":
            return value[2:].decode("utf-16-be", "replace")
        return value.decode("utf-8", "replace")
    if isinstance(value, bool):
        return str(value).lower()
    return value[1:] if isinstance(value, str) else str(value)


def read_pdf(body: bytes) -> dict:
    """page_count and info, sorted by key."""
    if b"%PDF-" not in body[:1024]:
        raise PdfError("no PDF header")
    objects = _objects(body)
    trailer: dict = {}
    for m in re.finditer(rb"\btrailer\b", body):
        t = _Reader(body, m.end()).value()
        if isinstance(t, dict):
            trailer |= t
    for v in objects.values():
        if isinstance(v, dict) and v.get("/Type") == "/XRef":
            trailer = v | trailer
    deref = lambda v: objects.get(v[1]) if isinstance(v, tuple) else v
    root = deref(trailer.get("/Root"))
    if not isinstance(root, dict):
        root = next((v for v in objects.values() if isinstance(v, dict) and v.get("/Type") == "/Catalog"), None)
    if root is None:
        raise PdfError("no catalog")
    pages, todo, seen = 0, [root.get("/Pages")], set()
    while todo:
        ref = todo.pop()
        if isinstance(ref, tuple):
            if ref[1] in seen:
                continue
            seen.add(ref[1])
        node = deref(ref)
        if isinstance(node, dict):
            kids = deref(node.get("/Kids"))
            if isinstance(kids, list):
                todo += kids
            else:
                pages += 1
    info = deref(trailer.get("/Info"))
    pairs = sorted((k[1:], _text(v, objects)) for k, v in info.items()) if isinstance(info, dict) else []
    return {"page_count": pages, "info": [{"key": k, "value": v} for k, v in pairs]}
