"""Running prose of a document: what is left without code, tables, traces and links."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_TRACE = re.compile(r"^[ \t]*Traceback \(most recent call last\):\n(?:[ \t]+[^\n]*(?:\n|\Z))*(?:[\w.]*(?:Error|Exception|Warning|Exit|Interrupt)\b[^\n]*)?", re.M)
# Lines that are no sentences: prompts, table rows, headings, rules, assignments, trailers, stack frames.
_LINE = re.compile(r"^[ \t]*(?:>>>|\.\.\. |\$ |\||#|[=~*_-]{3,}[ \t]*$|[\w.\[\]']+ [+*/-]?= \S|[A-Z][\w-]*-?[A-Za-z]*: \S+[ \t]*$|File \"|at [\w.$]+\(|[\w.]*(?:Error|Exception): ).*$", re.M)
_LINK = re.compile(r"(?:\bSee )?\[?\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+|\S+@\S+\.\S+", re.I)
_INLINE = re.compile(r"`[^`\n]*`")
# Remarks of the kind "(e.g. 1.2.3)": abbreviations and numbers only.
_ASIDE = re.compile(r"\((?:e\.g\.|i\.e\.|cf\.|approx\.|sec\.|rev\.|v|[\d.,; ])+\)")
# Names from code: with underscores, inner capitals, or dots, slashes and brackets between parts.
_NAME = re.compile(r"\w_|_\w|[a-z][A-Z]|\w(?:\.|/|::)\w|\w\(\)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = ".,;:!?()[]\"'“”‘’*"


def words(text: str | None) -> list[str]:
    """Words of the running prose of a text, in lower case and in order."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "Traceback (" in text:
        text = _TRACE.sub("\n", text)
    text = _LINE.sub("", text)
    if "://" in text or "www." in text or "@" in text:
        text = _LINK.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    while "(" in text:  # asides within asides
        text, n = _ASIDE.subn(" ", text)
        if not n:
            break
    out: list[str] = []
    for token in text.split():
        if token.islower() and token.isalpha():
            out.append(token)
            continue
        bare = token.strip(_ENDS)
        if bare.isalpha() and (bare.islower() or bare[1:].islower() or len(bare) == 1 or bare.isupper()) and not token.endswith("()"):
            out.append(bare.lower())
        elif not _NAME.search(token):
            out.extend(_WORD.findall(token.lower()))
    return out


# Frequent function words by language, to tell English from its neighbours.
ENGLISH = frozenset("the of and to in is that it for a an this with on are be not as by or was has have which when if each can at from they he she we its than then do does did no any all will would but so you there what who".split())
OTHERS = (
    frozenset("der die das und nicht ein eine einen dem den des wird werden ist sind mit nach bei wenn ohne im einmal zu auf für von auch aber oder".split()),
    frozenset("el la los las un una y que en se por con para del hay ya si lo su sin como más pero este esta al es".split()),
    frozenset("le la les des est dans pour que une un du au aux ne pas sur avec par sont ce cette il elle qui".split()),
    frozenset("il di che per non un una gli della del con sono è nel alla da le lo si come più".split()),
    frozenset("o os as um uma do da dos das em para com não que por se mais ao é".split()),
    frozenset("het een niet van de en is op te dat die voor met zijn aan er om ook".split()),
)


_MARKS = {w: [k for k, language in enumerate((ENGLISH, *OTHERS)) if w in language] for w in frozenset().union(ENGLISH, *OTHERS)}


def is_english(counts: dict[str, int]) -> bool:
    """Whether, by the counts of a text's words, no other language's function words outnumber the English ones.

    A text without function words of any of these languages passes if most of its words are ASCII,
    as dense technical English may have none.
    """
    if not counts:
        return False
    hits = [0] * (1 + len(OTHERS))
    for word in _MARKS.keys() & counts.keys():
        for k in _MARKS[word]:
            hits[k] += counts[word]
    if not any(hits):
        return sum(n for w, n in counts.items() if w.isascii()) > 0.9 * sum(counts.values())
    return hits[0] >= max(hits[1:])
