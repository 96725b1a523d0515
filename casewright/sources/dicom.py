"""A reader and writer of header files: an element tree of any depth, and the raw pixels.

Elements are read in the explicit and the implicit little-endian form, with defined and undefined lengths.  An
element's path names the sequences and items above it, ``0040A730[0].0040A123``; a sequence's own entry has the kind
``SQ`` and the number of its items as its value, so that dropping that entry drops what stands below.  Written
trees keep the form that was read, so an unchanged file comes out byte for byte.

A file that cannot be read to its end (cut short, an unknown form, nested deeper than ``DEEPEST``) has no tags but an
``error``; nothing is lost without a word.  Encapsulated pixels are kept in the file but not decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
_BYTES = frozenset("OB OD OF OL OV OW UN".split())
_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
_OPEN = 0xFFFFFFFF
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
DEEPEST = 64
PIXELS, ROWS, COLUMNS, SYNTAX = "7FE00010", "00280010", "00280011", "00020010"
#: The transfer syntaxes whose elements are not explicit little-endian.
IMPLICIT, BIG_ENDIAN, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
#: Kinds of elements that the implicit form does not spell; person names and what the engine reads.
KINDS = {
    kind: frozenset(tags.split())
    for kind, tags in {
        "PN": "00080090 0008009C 00081048 00081050 00081052 00081060 00081070 00100010 00101001 00101005 00101060 00102297 00321032 0038000B 00400006 0040000B 00401010 00401102"
        " 00402008 00404037 0040A075 0040A123 00700084 300E0008 30060028 40080102 4008010A 4008010B 4008010C 40080114 40080119",
        "UI": "00020002 00020003 00020010 00020012 00080014 00080016 00080018 00081150 00081155 0020000D 0020000E 00200052 0040A124",
        "DA": "00080012 00080020 00080021 00080022 00080023 00100030 0040A121",
        "TM": "00080013 00080030 00080031 00080032 00080033 0040A122",
        "CS": "00080005 00080008 00080060 00100040 00280004 0040A040",
        "SH": "00080050 00080094 00081010 00200010",
        "LO": "00080070 00080080 00081030 0008103E 00100020 00100021 0040A160",
        "IS": "00200011 00200013 00280008",
        "US": "00280002 00280010 00280011 00280100 00280101 00280102 00280103",
        "LT": "00204000",
        "OW": "7FE00010",
    }.items()
}


class HeaderError(ValueError):
    """A file that is not a readable header."""


@dataclass
class Element:
    tag: str
    kind: str
    value: bytes = b""
    items: list[list[Element]] | None = None
    open_: bool = False  # of undefined length
    open_items: list[bool] = field(default_factory=list)
    explicit: bool = True

    def text(self) -> str | None:
        """The value as text; numbers in decimal, several of them parted by a backslash; null for bytes."""
        if self.items is not None:
            return str(len(self.items))
        if form := _NUMBERS.get(self.kind):
            n = len(self.value) // struct.calcsize(form)
            return "\\".join(str(x) for x in struct.unpack(f"<{n}{form}", self.value[: n * struct.calcsize(form)]))
        if self.kind in _BYTES or self.kind == "AT":
            return None
        try:
            text = self.value.decode()
        except UnicodeDecodeError:
            text = self.value.decode("latin-1")
        return text.rstrip("\0 ")


def implicit_kind(tag: str, value: bytes) -> str:
    """The kind of an element that does not spell it: by its tag, else a sequence by its first bytes, else bytes."""
    known = next((kind for kind, tags in KINDS.items() if tag in tags), None)
    if known:
        return known
    return "SQ" if value[:4] == struct.pack("<HH", *_ITEM) else "UN"


# --- reading -----------------------------------------------------------------------------------------


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    def pair(self, at: int) -> tuple[int, int]:
        if at + 8 > len(self.raw):
            raise HeaderError(f"cut short at {at}")
        return struct.unpack_from("<HH", self.raw, at)

    def elements(self, at: int, end: int | None, explicit: bool, depth: int, meta: bool = False) -> tuple[list[Element], int]:
        """Elements up to ``end``, or up to the end of an item of undefined length; and where they ended.
        With ``meta`` they end with the group of file information."""
        if depth > DEEPEST:
            raise HeaderError(f"nested deeper than {DEEPEST}")
        out: list[Element] = []
        while end is None or at < end:
            group, element = self.pair(at)
            if (group, element) == _ITEM_END and end is None:
                return out, at + 8
            if meta and group != 2:
                break
            found, at = self.element(at, f"{group:04X}{element:04X}", explicit, depth)
            if end is not None and at > end:
                raise HeaderError(f"{found.tag} runs over its container's end")
            out.append(found)
        return out, at

    def element(self, at: int, tag: str, explicit: bool, depth: int) -> tuple[Element, int]:
        if explicit:
            kind = self.raw[at + 4 : at + 6].decode("latin-1")
            if not (kind.isascii() and kind.isalpha() and kind.isupper()):
                raise HeaderError(f"no kind of element at {at}")
            head = 12 if kind in _LONG else 8
            if at + head > len(self.raw):
                raise HeaderError(f"cut short at {at}")
            size = struct.unpack_from("<I", self.raw, at + 8)[0] if head == 12 else struct.unpack_from("<H", self.raw, at + 6)[0]
        else:
            size, head = struct.unpack_from("<I", self.raw, at + 4)[0], 8
            kind = "SQ" if size == _OPEN and tag != PIXELS else implicit_kind(tag, self.raw[at + 8 : at + 12])
        at += head
        if size != _OPEN and at + size > len(self.raw):
            raise HeaderError(f"{tag} runs over the file's end")
        if kind == "SQ" or kind == "UN" and size == _OPEN:
            # A sequence whose kind was lost on the way is written in the implicit form.
            return self.sequence(at, Element(tag, kind, explicit=explicit), size, explicit and kind == "SQ", depth)
        if size == _OPEN:
            value, at = self.fragments(at)
            return Element(tag, kind, value, open_=True, explicit=explicit), at
        return Element(tag, kind, self.raw[at : at + size], explicit=explicit), at + size

    def sequence(self, at: int, found: Element, size: int, explicit: bool, depth: int) -> tuple[Element, int]:
        found.items, found.open_ = [], size == _OPEN
        end = None if size == _OPEN else at + size
        while end is None or at < end:
            mark, length = self.pair(at), struct.unpack_from("<I", self.raw, at + 4)[0]
            at += 8
            if mark == _SEQUENCE_END and end is None:
                return found, at
            if mark != _ITEM:
                raise HeaderError(f"no item in {found.tag} at {at - 8}")
            item, at = self.elements(at, None if length == _OPEN else at + length, explicit, depth + 1)
            found.items.append(item)
            found.open_items.append(length == _OPEN)
        if at != end:
            raise HeaderError(f"{found.tag} runs over its end")
        return found, at

    def fragments(self, at: int) -> tuple[bytes, int]:
        """The raw items of encapsulated pixels, with their end mark."""
        begin = at
        while True:
            mark, length = self.pair(at), struct.unpack_from("<I", self.raw, at + 4)[0]
            at += 8
            if mark == _SEQUENCE_END:
                return self.raw[begin:at], at
            if mark != _ITEM or length == _OPEN or at + length > len(self.raw):
                raise HeaderError(f"broken fragment at {at - 8}")
            at += length


def read_tree(raw: bytes) -> tuple[bytes, list[Element]]:
    """What stands before the first element, and all top-level elements."""
    at = 132 if raw[128:132] == b"DICM" else 0
    if len(raw) - at < 8:
        raise HeaderError("no element")
    reader = _Reader(raw)
    meta, end = reader.elements(at, len(raw), True, 0, meta=True) if at else ([], 0)
    syntax = next((e.text() for e in meta if e.tag == SYNTAX), None)
    if syntax in (BIG_ENDIAN, DEFLATED):
        raise HeaderError(f"transfer syntax {syntax} is not read")
    letters = raw[end + 4 : end + 6]
    explicit = syntax != IMPLICIT if syntax else letters.isalpha() and letters.isupper()
    rest, _ = reader.elements(end, len(raw), explicit, 0)
    return raw[:at], meta + rest


def flatten(elements: list[Element], prefix: str = "") -> dict[str, tuple[str, str | None]]:
    """Path -> (kind, text) of a tree, pixels left out."""
    out: dict[str, tuple[str, str | None]] = {}
    for e in elements:
        if e.tag != PIXELS:
            out[prefix + e.tag] = e.kind, e.text()
        for i, item in enumerate(e.items or ()):
            out |= flatten(item, f"{prefix}{e.tag}[{i}].")
    return out


def parse(raw: bytes) -> tuple[dict[str, tuple[str, str | None]], int | None, int | None, bytes | None]:
    """Path -> (kind, text), rows, columns and pixel bytes; nothing of what is no header."""
    try:
        _, tree = read_tree(raw)
    except HeaderError:
        return {}, None, None, None
    return _parts(tree)


def _parts(tree: list[Element]) -> tuple[dict[str, tuple[str, str | None]], int | None, int | None, bytes | None]:
    number = {e.tag: int.from_bytes(e.value[:2], "little") for e in tree if e.tag in (ROWS, COLUMNS)}
    pixels = next((e.value for e in tree if e.tag == PIXELS and not e.open_), None)
    return flatten(tree), number.get(ROWS), number.get(COLUMNS), pixels


# --- writing -----------------------------------------------------------------------------------------


def encode_value(kind: str, text: str) -> bytes:
    if form := _NUMBERS.get(kind):
        number = float if form in "fd" else int
        return b"".join(struct.pack(f"<{form}", number(x)) for x in text.split("\\") if x)
    value = text.encode()
    return value + (b"\0" if kind == "UI" else b" ") * (len(value) % 2)


def _head(e: Element, size: int) -> bytes:
    tag = struct.pack("<HH", int(e.tag[:4], 16), int(e.tag[4:], 16))
    if not e.explicit:
        return tag + struct.pack("<I", size)
    kind = e.kind.encode("latin-1")
    if e.kind in _LONG:
        return tag + kind + struct.pack("<HI", 0, size)
    if size > 0xFFFF:
        raise HeaderError(f"{e.tag} is too long for its kind")
    return tag + kind + struct.pack("<H", size)


def write_elements(elements: list[Element]) -> bytes:
    parts = []
    for e in elements:
        if e.items is None:
            parts += _head(e, _OPEN if e.open_ else len(e.value)), e.value
            continue
        body = []
        for item, undefined in zip(e.items, e.open_items):
            inner = write_elements(item)
            body += struct.pack("<HHI", *_ITEM, _OPEN if undefined else len(inner)), inner
            body += [struct.pack("<HHI", *_ITEM_END, 0)] if undefined else []
        whole = b"".join(body)
        parts += _head(e, _OPEN if e.open_ else len(whole)), whole
        parts += [struct.pack("<HHI", *_SEQUENCE_END, 0)] if e.open_ else []
    return b"".join(parts)


def applied(elements: list[Element], tags: dict[str, tuple[str, str | None]], prefix: str = "") -> list[Element]:
    """The tree without elements that ``tags`` lacks and with the values that differ there; pixels stay."""
    out = []
    for e in elements:
        path = prefix + e.tag
        if e.tag == PIXELS or path not in tags:
            out += [e] if e.tag == PIXELS else []
        elif e.items is not None:
            out.append(replace(e, items=[applied(item, tags, f"{path}[{i}].") for i, item in enumerate(e.items)]))
        else:
            text = tags[path][1]
            out.append(e if text is None or text == e.text() else replace(e, value=encode_value(e.kind, text)))
    return out


def rewrite_bytes(raw: bytes, tags: dict[str, tuple[str, str | None]]) -> bytes:
    """The file with the elements and values of ``tags``; what is equal there stays byte for byte."""
    head, tree = read_tree(raw)
    return head + write_elements(applied(tree, tags))


def build_tree(tags: dict[str, tuple[str, str | None]], explicit: bool = True, undefined: bool = False) -> list[Element]:
    """The tree of a path map; sequences need no entry of their own."""
    leaves: dict[str, Element] = {}
    below: dict[str, dict[int, dict[str, tuple[str, str | None]]]] = {}
    for path, (kind, text) in tags.items():
        first, _, rest = path.partition(".")
        if rest:
            tag, _, number = first.partition("[")
            below.setdefault(tag, {}).setdefault(int(number[:-1]), {})[rest] = kind, text
        elif kind == "SQ":
            for i in range(int(text or 0)):
                below.setdefault(path, {}).setdefault(i, {})
        else:
            leaves[path] = Element(path, kind, encode_value(kind, text or ""), explicit=explicit)
    for tag, items in below.items():
        trees = [build_tree(items.get(i, {}), explicit, undefined) for i in range(max(items) + 1)]
        leaves[tag] = Element(tag, "SQ", items=trees, open_=undefined, open_items=[undefined] * len(trees), explicit=explicit)
    return [leaves[tag] for tag in sorted(leaves)]


def build(tags: dict[str, tuple[str, str | None]], rows: int, cols: int, pixels: bytes, explicit: bool = True, undefined: bool = False) -> bytes:
    """A file of these elements and 8-bit pixels; ``undefined`` leaves the lengths of sequences and items open."""
    own = tags | {ROWS: ("US", str(rows)), COLUMNS: ("US", str(cols))} | ({} if explicit else {SYNTAX: ("UI", IMPLICIT)})
    meta = build_tree({k: v for k, v in own.items() if k.startswith("0002")})
    body = build_tree({k: v for k, v in own.items() if not k.startswith("0002")}, explicit, undefined)
    data = Element(PIXELS, "OB", pixels + b"\0" * (len(pixels) % 2), explicit=explicit)
    return b"\0" * 128 + b"DICM" + write_elements(meta + body + [data])


# --- columns -----------------------------------------------------------------------------------------

_ELEMENT = T.StructType([T.StructField("vr", T.StringType()), T.StructField("value", T.StringType())])
_TAGS = T.MapType(T.StringType(), _ELEMENT)
HEADER = T.StructType(
    [
        T.StructField("tags", _TAGS),
        T.StructField("rows", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW_TAGS = pa.map_(pa.string(), pa.struct([("vr", pa.string()), ("value", pa.string())]))
_ARROW = pa.struct([("tags", _ARROW_TAGS), ("rows", pa.int32()), ("cols", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


#: Rows of a batch that are Python objects at a time; a header is some hundred of them.
PIECE_ROWS = 128


def _by_pieces(work: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``work`` over a few rows of the columns at a time, as one array: what stands in memory as Python objects does not
    grow with the batch."""
    done = [pa.array(work(*(c.slice(at, PIECE_ROWS) for c in columns)), kind) for at in range(0, len(columns[0]), PIECE_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _headers(content: pa.Array) -> list[dict]:
    rows = []
    for raw in content:
        try:
            tags, height, width, pixels = _parts(read_tree(raw.as_py() or b"")[1])
            rows.append({"tags": [(k, {"vr": v[0], "value": v[1]}) for k, v in tags.items()], "rows": height, "cols": width, "pixels": pixels, "error": None})
        except HeaderError as e:
            rows.append({"tags": None, "rows": None, "cols": None, "pixels": None, "error": str(e)})
    return rows


@F.arrow_udf(HEADER)
def _parsed(content: pa.Array) -> pa.Array:
    return _by_pieces(_headers, _ARROW, content)


def decode(content: Column) -> Column:
    """Header map by path, pixels and error of file bytes."""
    return _parsed(content)


def _pairs(tags) -> dict[str, tuple[str, str | None]]:
    return {k: (v["vr"], v["value"]) for k, v in tags}


@F.arrow_udf(T.BinaryType())
def _rewritten(content: pa.Array, tags: pa.Array) -> pa.Array:
    def one(raw, own):
        return None if raw is None or own is None else rewrite_bytes(raw, _pairs(own))

    return _by_pieces(lambda raws, owns: [one(raw.as_py(), own.as_py()) for raw, own in zip(raws, owns)], pa.binary(), content, tags)


def rewrite(content: Column, tags: Column) -> Column:
    """File bytes with the elements of a header map; null where either is null."""
    return _rewritten(content, tags)


@F.arrow_udf(T.BinaryType())
def _encoded(tags: pa.Array, rows: pa.Array, cols: pa.Array, pixels: pa.Array, explicit: pa.Array, undefined: pa.Array) -> pa.Array:
    def built(*columns: pa.Array) -> list[bytes | None]:
        given = zip(*(c.to_pylist() for c in columns))
        return [None if t is None or p is None else build(_pairs(t), r, c, p, e, u) for t, r, c, p, e, u in given]

    return _by_pieces(built, pa.binary(), tags, rows, cols, pixels, explicit, undefined)


def encode(tags: Column, rows: Column, cols: Column, pixels: Column, explicit: Column | None = None, undefined: Column | None = None) -> Column:
    """File bytes of a header map and 8-bit pixels."""
    return _encoded(tags, rows.cast("int"), cols.cast("int"), pixels, F.lit(True) if explicit is None else explicit, F.lit(False) if undefined is None else undefined)
