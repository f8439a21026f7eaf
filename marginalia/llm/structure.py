"""Atomic blocks of the corpus' markdown: fences, display formulas, figure blocks, pipe tables."""

from __future__ import annotations

import re

_OPEN = re.compile(
    r"^[ \t]{0,3}(?P<fence>`{3,}|~{3,})[^\n]*$"
    r"|(?P<math>\$\$)"
    r"|^[ \t]*--- \[FIGURE\] ---[ \t]*$(?P<figure>)"
    r"|^(?P<table>[ \t]*\|[^\n]*\n[ \t]*\|[^\n]*(?:\n[ \t]*\|[^\n]*)*)",
    re.M,
)
_FIGURE_END = re.compile(r"^[ \t]*--- \[/FIGURE\] ---[ \t]*$", re.M)


def atomic_blocks(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of blocks that belong together, in order, never overlapping.

    The first opener wins, so marks inside an open block don't count. A fence without an end
    runs to the end of the text; a formula or figure without an end isn't a block.
    """
    out: list[tuple[int, int, str]] = []
    at = 0
    while m := _OPEN.search(text, at):
        if fence := m["fence"]:
            close = re.compile(rf"^[ \t]{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", re.M).search(text, m.end())
            end, kind = (close.end() if close else len(text)), "code_block"
        elif m["math"]:
            stop = text.find("$$", m.end())
            if stop < 0:
                at = m.end()
                continue
            end, kind = stop + 2, "formula"
        elif m["table"]:
            end, kind = m.end(), "table"
        else:
            close = _FIGURE_END.search(text, m.end())
            if not close:
                at = m.end()
                continue
            end, kind = close.end(), "figure"
        out.append((m.start(), end, kind))
        at = max(end, m.end())
    return out
