"""Notebooks flattened to text: their cells, and the paragraphs of prose in text cells."""

from __future__ import annotations

import re

_OUTPUTS = r"\[[^\]\n]*\]"
#: A line that marks a cell begins it; the groups are text, code and output.
MARKS = {
    "percent": re.compile(r"^# %% \[(?:(markdown)|(code)|(output))\][^\n]*\n?", re.M),
    "prompt": re.compile(rf"^(?:(Text)|(In {_OUTPUTS})|(Out {_OUTPUTS})):[^\n]*\n?", re.M),
    "fenced": re.compile(r"^:::cell (?:(text)|(code)|(output))\b[^\n]*\n?", re.M),
}
KINDS = ["text", "code", "output"]
PROSE_CHARS = 40
_GAP = re.compile(r"\n[^\S\n]*\n")
_ASIDE = re.compile(r"\*[^*\n]*\*|_[^_\n]*_")
_INLINE = re.compile(r"`[^`\n]*`|\$[^$\n]*\$|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|<[^<>\n]{1,200}>")
_SKIP = ("#", "|", "$$", "![", "<")


def cells(text: str, layout: str | None) -> list[tuple[str, str]]:
    """(kind, content) of each cell; what stands before the first mark is text. An unknown layout knows all marks."""
    known = [MARKS[layout]] if layout in MARKS else list(MARKS.values())
    marks = sorted((m.start(), m.end(), KINDS[m.lastindex - 1]) for p in known for m in p.finditer(text))
    out = [("text", text[:marks[0][0]] if marks else text)]
    for (_, end, kind), after in zip(marks, [*marks[1:], (len(text),)]):
        out.append((kind, text[end:after[0]]))
    return out


def prose(text: str | None, layout: str | None) -> list[str]:
    """Paragraphs of prose in text cells: lines between blank lines, without headings, tables, formulas, asides and fenced code."""
    found: list[str] = []
    if not text:
        return found
    for kind, content in cells(text.replace("\r\n", "\n"), layout):
        if kind != "text" or len(content) < PROSE_CHARS:
            continue
        fenced = formula = False
        for paragraph in _GAP.split(content):
            kept = []
            for line in paragraph.split("\n"):
                line = line.strip()
                if line.startswith("```"):
                    fenced = not fenced
                elif line == "$$":
                    formula = not formula
                elif line and not (fenced or formula or line.startswith(_SKIP) or _ASIDE.fullmatch(line)):
                    kept.append(line.removeprefix("- "))
            if sum(map(len, kept)) + max(0, len(kept) - 1) >= PROSE_CHARS:
                found.append(_INLINE.sub(" ", " ".join(kept)))
    return found
