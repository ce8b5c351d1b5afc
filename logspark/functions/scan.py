"""Scanners of one record's text, for use inside Arrow batches: fields of braces, pairs of a technical log record."""

from __future__ import annotations

import json
import re
from collections import deque

#: A quoted part may hold anything, a doubled quote stands for itself, and a missing closer takes the rest.
_PART = re.compile(r'"[^"]*(?:""[^"]*)*(?:"|\Z)|[{},]|[^"{},]+')
_PAIR = re.compile(r"""([^=,\r\n]+)=[^\S\r\n]*('[^']*(?:''[^']*)*(?:'|\Z)|"[^"]*(?:""[^"]*)*(?:"|\Z)|[^,\r\n]*)""")
_CONTROL = {c: None for c in (*range(32), *range(127, 160), 0xFEFF)}
_FLAT = _CONTROL | {9: "\t", 10: " "}
_LINES = _CONTROL | {9: "  ", 10: "\n"}


def fields(raw: str) -> list[str]:
    """The fields of one brace record, trimmed: commas inside quotes and nested braces, however deep, do not split."""
    body = re.sub(r"^\s*\{", "", raw)
    body = re.sub(r"\}\s*,?\s*$", "", body)
    out, parts, depth = [], [], 0
    for part in _PART.findall(body):
        if part == "," and not depth:
            out.append("".join(parts).strip())
            parts = []
            continue
        if part == "{":
            depth += 1
        elif part == "}" and depth:
            depth -= 1
        parts.append(part)
    out.append("".join(parts).strip())
    return out


def depth(text: str) -> int:
    """Braces that are open at the end of a text; an open quote counts as one."""
    level = 0
    for part in _PART.findall(text):
        if part[0] == '"':
            level += len(part) - len(part.rstrip('"')) == 0 or len(part) == 1
        else:
            level += (part == "{") - (part == "}")
    return level


def bare(value: str) -> str:
    """A value without its quotes, doubled ones undone."""
    mark = value[:1]
    if mark not in ("'", '"') or not mark:
        return value.strip()
    # the pattern ends a closed value at its closer: an odd run of quotes at the end has one
    tail = len(value) - len(value.rstrip(mark))
    closed = tail % 2 == (0 if tail == len(value) else 1) and len(value) > 1
    return (value[1:-1] if closed else value[1:]).replace(mark * 2, mark)


def pairs(text: str) -> dict[str, tuple[str, str]]:
    """(key as first written, last value) by lower-cased key; ':' in keys reads as '_'."""
    out: dict[str, tuple[str, str]] = {}
    for key, value in _PAIR.findall(text):
        key = key.strip(" \t\f\v").replace(":", "_")
        low = key.lower()
        out[low] = (out[low][0] if low in out else key, bare(value))
    return out


def cut(text: str, most: int) -> str:
    return f"{text[:most]}... [TRUNCATED: {len(text)} -> {most} chars]" if len(text) > most else text


def flat(text: str, most: int = 65_536) -> str:
    """One line: BOM and control characters go, LF becomes a space, TAB stays."""
    return cut(text if text.isprintable() else text.translate(_FLAT), most)


def lines(text: str, most: int = 65_536) -> str:
    """Lines stay: BOM and other control characters go, TAB becomes two spaces, ends are trimmed."""
    return cut((text if text.isprintable() else text.translate(_LINES)).strip(), most)


_JSON_PART = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}]', re.S)


def objects(text: str) -> list[str]:
    """Balanced {...} parts of a text, outermost first found; braces inside strings do not count."""
    out, level, start = [], 0, 0
    for m in _JSON_PART.finditer(text):
        if m[0] == "{":
            if not level:
                start = m.start()
            level += 1
        elif m[0] == "}" and level:
            level -= 1
            if not level:
                out.append(text[start : m.end()])
    return out


def _nested(text: str) -> list[tuple[int, int, list]]:
    """(start, end, those within) of the balanced {...} parts of a text; an outermost one that is never closed counts for nothing, nor does what it holds."""
    found, opened = [], []
    for m in _JSON_PART.finditer(text):
        if m[0] == "{":
            opened.append((m.start(), []))
        elif m[0] == "}" and opened:
            start, within = opened.pop()
            (opened[-1][1] if opened else found).append((start, m.end(), within))
    return found


def records(text: str, required: list[str]) -> list[str]:
    """The outermost objects of a text that have all required members, however deep they are wrapped; what does not parse is looked into as well.

    The text is scanned once. An object is parsed only if it names the members outside of the objects within it (or has escapes).
    """
    names = [f'"{k}"' for k in required]
    out, waiting = [], deque(_nested(text))
    while waiting:
        start, end, within = waiting.popleft()
        at, own = start, []
        for begin, stop, _ in within:
            own.append(text[at:begin])
            at = stop
        own = "".join([*own, text[at:end]])
        members = {}
        if "\\" in own or all(name in own for name in names):
            try:
                members = json.loads(text[start:end])
            except ValueError:
                pass
        if all(members.get(k) is not None for k in required):
            out.append(text[start:end])
        else:
            waiting.extend(within)
    return out


#: A string (a raw line break ends a broken one), the colon that makes it a member's name unless its value is null, or a brace.
_MEMBER = re.compile(r'"([^"\\\n]*(?:\\[^\n]?[^"\\\n]*)*)(?:(")(\s*:(?!\s*null\b))?|\n|\Z)|[{}]')
_CLOSER = re.compile(r'[^"\\\n]*(?:\\[^\n]?[^"\\\n]*)*(["\n])')


class JsonSplit:
    """Reads one split of a JSON text, piece by piece. Depth counts from the split's start; nothing is known of what is open there but in_string.

    A piece must not end right after a backslash. least is the lowest depth so far (0 or below):
    starts[j] are the required members seen in the object that is the j-th open one at the start,
    counted from the innermost; opened has those of objects opened here and still open.
    """

    def __init__(self, required: list[str], in_string: bool):
        self.bits = {name: 1 << k for k, name in enumerate(required)}
        self.in_string, self.least, self.starts, self.opened = in_string, 0, [0], []

    def feed(self, text: str) -> None:
        at = 0
        if self.in_string:
            if not (m := _CLOSER.match(text)):
                return
            at, self.in_string = m.end(), False
        opened, bits = self.opened, self.bits
        for m in _MEMBER.finditer(text, at):
            if m[0] == "{":
                self.open(m.start())
            elif m[0] == "}":
                self.close(m.end())
            elif m[3]:
                if bit := bits.get(m[1]):
                    if opened:
                        opened[-1] |= bit
                    else:
                        self.starts[-1] |= bit
            elif not m[2] and m[0][-1] != "\n":
                self.in_string = True

    def open(self, at: int) -> None:
        self.opened.append(0)

    def close(self, at: int) -> None:
        if self.opened:
            self.opened.pop()
        else:
            self.least -= 1
            self.starts.append(0)


class JsonRecords(JsonSplit):
    """Reads a split of which it is known what is open at its start and what crosses its ends.

    depth objects are open at the start; into and out are the levels of the records that cross the
    start and the end (0: none), found from all splits. whole gets the texts of records that begin and
    end here, head the rest of the record that crosses the start, tail the beginning of the one that
    crosses the end; a record that crosses both is head alone.
    """

    def __init__(self, required: list[str], in_string: bool, depth: int, into: int, out: int):
        super().__init__(required, in_string)
        self.depth, self.into, self.out, self.all = depth, into, out, (1 << len(required)) - 1
        self.whole: list[str] = []
        self.head: str | None = None
        self.tail: str | None = None
        self.pieces: list[str] = []
        self.base = self.start = 0  # places of pieces[0], and of the text that is being read
        self.frames: list[tuple[int, list[str]]] = []  # of opened: where each began, and the records within
        self.inside = into > 0

    def feed(self, text: str) -> None:
        self.pieces.append(text)
        super().feed(text)
        self.start += len(text)
        if not self.frames and not self.inside:
            self.pieces, self.base = [], self.start

    def _text(self, begin: int, end: int) -> str:
        if len(self.pieces) > 1:
            self.pieces = ["".join(self.pieces)]
        return self.pieces[0][begin - self.base : end - self.base]

    def open(self, at: int) -> None:
        super().open(at)
        self.frames.append((self.start + at, []))

    def close(self, at: int) -> None:
        if not self.opened:
            super().close(at)
            if self.inside and max(0, self.depth + self.least) < self.into:
                self.head, self.inside = self._text(0, self.start + at), False
            return
        members = self.opened[-1]
        super().close(at)
        begin, within = self.frames.pop()
        if self.inside:
            return
        found = [self._text(begin, self.start + at)] if members == self.all else within
        (self.frames[-1][1] if self.frames else self.whole).extend(found)

    def finish(self) -> None:
        if self.inside:
            self.head = "".join(self.pieces)
            return
        below = max(0, self.depth + self.least)
        for level, (begin, within) in enumerate(self.frames, below + 1):
            if level == self.out:
                self.tail = self._text(begin, self.start)
                break
            self.whole += within


def crossing_records(splits: list[tuple[int, dict]], required: int) -> list[tuple[int, bool, int, int, int, int, int]]:
    """(split, in string, depth, into, out, begun, ends) of the splits of one text, in order.

    splits: (place, {in_string: (in_string after, least, starts, opened)}). begun and ends are the splits in
    which the records that cross the start and the end have begun. An object that never closes is no record.
    """
    in_string, stack, out = False, [], []
    for place, ways in splits:
        after, least, starts, opened = ways[in_string]
        begin = (in_string, list(stack))
        for j, members in enumerate(starts):
            if stack:
                stack[-1]["members"] |= members
                if j < -least:
                    stack.pop()["closed"] = True
        stack = stack + [{"members": m, "closed": False, "split": place} for m in opened]
        in_string = after
        out.append((place, begin, list(stack)))
    whole = (1 << required) - 1

    def first(objects: list[dict]) -> tuple[int, int]:
        """(level, split in which it began) of the outermost record."""
        return next(((level, o["split"]) for level, o in enumerate(objects, 1) if o["members"] == whole and o["closed"]), (0, -1))

    found = []
    for place, (string, objects), then in out:
        (into, begun), (level, ends) = first(objects), first(then)
        found.append((place, string, len(objects), into, level, begun, ends))
    return found
