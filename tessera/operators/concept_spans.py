"""Splitting along statements of law: definitions, rights, exceptions, conditions and procedures stay in one piece.

A concept reaches from its cue to the end of its sentence. Its spans, headings and sentence ends are the places where a
chunk may end. Texts are walked one by one in Arrow batches, in time near linear in their length; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from .fusion import LEVEL_WEIGHTS
from .splitting import walked

ENDS = "。！？"
#: What lies between the words of a cue, and between a cue and the end of its sentence.
GAP, REST = f"[^{ENDS}\\n]{{0,200}}?", f"[^{ENDS}\\n]*"
#: The weight of each kind of concept and the patterns of its cues.
CUES = {
    "definition": (1.0, (f"本法所稱{GAP}是指{REST}", f"指{GAP}者{REST}", f"為{GAP}者{REST}")),
    "right_definition": (0.9, (f"著作人專有{GAP}權利{REST}", f"商標權人{GAP}權利{REST}", f"專有{GAP}權利{REST}")),
    "exception_clause": (0.8, (f"但{REST}", f"不在此限{REST}", f"除外{REST}")),
    "conditional_clause": (0.7, (f"有下列情形之一{REST}", f"如{GAP}時{REST}", f"於{GAP}情形{REST}")),
    "procedural_clause": (0.6, (f"應{GAP}申請{REST}", f"得{GAP}辦理{REST}", f"依{GAP}程序{REST}")),
}
#: Least and most characters of a chunk of each granularity level, and kinds of concept that it keeps at any length.
LEVEL_SIZES = {"document": (2000, 10000), "document_component": (1000, 3000), "basic_unit_hierarchy": (500, 1500), "basic_unit": (200, 800), "basic_unit_component": (100, 400), "enumeration": (50, 200)}
LEVEL_KINDS = {"basic_unit_component": ("definition",)}
STRUCTURE = r"第\s*\d+\s*[條章節項]"


def _patterns() -> dict[str, list[re.Pattern]]:
    return {kind: [re.compile(cue) for cue in cues] for kind, (_, cues) in CUES.items()}


class _Spans:
    """Concepts of one text and the places where chunks may end."""

    def __init__(self, text: str, patterns: dict[str, list[re.Pattern]]):
        found = sorted({(m.start(), m.end(), kind) for kind, some in patterns.items() for p in some for m in p.finditer(text)})
        self.found, self.starts = found, [a for a, _, _ in found]
        self.furthest = list(accumulate((b for _, b, _ in found), max))
        backward = sorted(((b, a) for a, b, _ in found), reverse=True)
        self.ends = [b for b, _ in reversed(backward)]
        self.earliest = list(accumulate((a for _, a in backward), min))[::-1]
        places = {m.start() for m in re.finditer(STRUCTURE, text)} | {m.end() for m in re.finditer(f"[{ENDS}]", text)}
        self.places = sorted(places.union(*((a, b) for a, b, _ in found)))

    def stop(self, at: int, most: int) -> int:
        """The last place in (at, most], or most."""
        k = bisect_right(self.places, most) - 1
        return self.places[k] if k >= 0 and self.places[k] > at else most

    def cut(self, at: int) -> tuple[int, int]:
        """The stretch of all concepts that begin before `at` and end after it; (at, at) if none does."""
        i, j = bisect_right(self.ends, at), bisect_left(self.starts, at)
        return min(at, self.earliest[i]) if i < len(self.ends) else at, max(at, self.furthest[j - 1]) if j else at

    def whole(self, start: int, end: int) -> tuple[int, int]:
        """The span with every concept that its two ends cut."""
        (a, b), (c, d) = self.cut(start), self.cut(end)
        return min(a, c), max(b, d)

    def kinds(self, start: int, end: int) -> list[str]:
        at = slice(bisect_left(self.starts, start), bisect_left(self.starts, end))
        inside = {kind for _, b, kind in self.found[at] if b <= end}
        return [kind for kind in CUES if kind in inside]


def _chunks(text: str, spans: _Spans, size: int, overlap: int, whole: bool):
    at, n = 0, len(text)
    while at < n:
        stop = spans.stop(at, min(n, at + size)) if at + size < n else n
        start, end = spans.whole(at, stop) if whole else (at, stop)
        if text[start:end].strip():
            kinds = spans.kinds(start, end)
            yield text[start:end], start, end, kinds, round(sum(CUES[k][0] for k in kinds), 6)
        at = n if stop == n else max(at + 1, stop - overlap) if stop - overlap > at else stop


def concept_windows(docs: DataFrame, size: int = 1000, overlap: float = 0.1, whole: bool = True) -> DataFrame:
    """Chunks of about `size` characters that end at the last possible place: (content, start, end, kinds, importance).

    whole: a chunk also takes in all of every concept that its ends cut, so it may be longer than size. kinds: the kinds of
    concept that lie in it; importance: the sum of their weights. The next chunk starts overlap * size before the end that
    was found. Where there is no place, windows of `size` are cut. Null and blank texts have no chunks.
    """
    if size < 1 or not 0 <= overlap < 1:
        raise ValueError("need size >= 1 and 0 <= overlap < 1")
    patterns = _patterns()
    return walked(docs, lambda text: _chunks(text, _Spans(text, patterns), size, int(size * overlap), whole), "content string, start int, end int, kinds array<string>, importance double")


def concept_levels(docs: DataFrame, overlap: float = 0.1, sizes: dict[str, tuple[int, int]] = LEVEL_SIZES, keeps: dict[str, tuple] = LEVEL_KINDS) -> DataFrame:
    """concept_windows for every granularity level in one walk; a chunk stays if its length suits the level or it holds one of its kinds."""
    patterns = _patterns()
    if unknown := set(sizes) - set(LEVEL_WEIGHTS):
        raise ValueError(f"unknown levels {sorted(unknown)}")

    def walk(text: str):
        spans = _Spans(text, patterns)
        for level, (least, most) in sizes.items():
            for chunk in _chunks(text, spans, most, int(most * overlap), True):
                if least <= len(chunk[0]) <= most or set(keeps.get(level, ())) & set(chunk[3]):
                    yield level, *chunk

    return walked(docs, walk, "level string, content string, start int, end int, kinds array<string>, importance double")
