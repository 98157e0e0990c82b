"""Layout statistics of one source text.

Everything here is plain Python over a whole text (never a prefix); the
distributed part is in :mod:`graphmill.llm.handwritten`.
"""

from __future__ import annotations

import re
from collections import Counter

# Directory names under which package managers and people keep third-party code.
VENDOR_SEGMENTS = (
    "third_party", "thirdparty", "_thirdparty", "3rdparty", "third-party", "vendor", "_vendor", "vendored", "vendors",
    "extern", "external", "externals", "bundled", "_bundled", "node_modules", "site-packages", "dist-packages", "bower_components",
)

# File name endings given by generators.
GENERATED_STEMS = r"(?:_pb2|_pb2_grpc|[._-]gen|[._-]generated|_stubs_auto|\.g|\.designer|^\d{4}_auto_\w+)$"

_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"")
_TRIPLE = re.compile(r"'''(.*?)'''|\"\"\"(.*?)\"\"\"", re.S)
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_KEYWORDS = frozenset(b"def return if else elif for in not and or is None True False class import from as while try except with yield lambda assert raise pass break continue global del self function const let var new this null true false".split())

# What a header says of a file that is program output. The first alone is enough, at the start of a line or as a tag ...
_STATED = re.compile(
    r"@generated\b|^\W*code generated by\b|^\W*(?:auto[- ]?|automatically )?generated (?:by|from|with)\b|^\W*auto-?generated (?:file|code)\b|\bthis (?:file|module|code|script) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?generated\b",
    re.I,
)
# ... otherwise one line has to say both that something made it, in one of several languages, and that it is not to be edited.
_MADE = re.compile(
    r"\b(?:auto|machine)[- ]?(?:generated|output|written|made)\b|\bgenerated\b|\b(?:erzeugt|generiert|generado|gerado|gegenereerd|g[ée]n[ée]r[ée])\b"
    r"|\b(?:automatically|automatisch|autom\w+) (?:built|compiled|created|emitted|exported|produced|written|erstellt)\b|\bthis (?:file|module|code|script) (?:was|is|has been) (?:built|compiled|created|emitted|exported|produced|written)\b",
    re.I,
)
_KEPT_OFF = re.compile(
    r"\b(?:do not|don'?t|never|must not|should not)\s+(?:be )?(?:\w+ ){0,2}?(?:alter|change|edit|modif|touch)|\b(?:changes?|edits?)\b[^.;]{0,40}\b(?:discarded|lost|overwritten)\b|\binstead of (?:changing|editing|modifying|touching)\b"
    r"|\bnicht\b[^.;]{0,30}\b(?:ändern|aendern|bearbeiten|editieren)\b|\bno (?:editar|modificar)\b|\bne pas (?:modifier|éditer)\b|\bniet (?:bewerken|wijzigen)\b",
    re.I,
)

_BLOCK_COMMENTS = {"/*": "*/", "<!--": "-->"}
_DOCSTRING = re.compile(r"[rRuU]?('''|\"\"\")(.*?)\1[^\n]*\n?", re.S)


def header_lines(text: str) -> list[str]:
    """Lines of the comments and of the docstring before the first statement: after ``#``, ``//``, ``--`` or ``%``, in ``/* */``, ``<!-- -->`` or triple quotes."""
    out: list[str] = []
    rest = text.lstrip("﻿")
    quoted = False
    while rest := rest.lstrip():
        line, _, after = rest.partition("\n")
        opening = next((x for x in _BLOCK_COMMENTS if line.startswith(x)), None)
        if line.startswith(("#", "//", "-- ", "% ")):
            out.append(line)
            rest = after
        elif opening:
            inside, _, rest = rest[len(opening) :].partition(_BLOCK_COMMENTS[opening])
            out += [x.strip(" \t*!") for x in inside.split("\n")]
        elif not quoted and (found := _DOCSTRING.match(rest)):
            out += found[2].split("\n")
            rest = rest[found.end() :]
            quoted = True
        else:
            break
    return [x.strip() for x in out]


def says_generated(text: str) -> bool:
    """Whether a text's own header says that a program wrote it. What a text says further down, or of other files in passing, is no header."""
    return any(_STATED.search(x) or (_MADE.search(x) and _KEPT_OFF.search(x)) for x in header_lines(text))


_PYTHON_HEADS = ("def ", "class ", "async def ")
_INNER_HEADS = ("    def ", "\tdef ", "    async def ")
_COMMENTS = ("#", "//", "/*", "*", "--", "<!--")
# The first line of a definition in languages with braces or statements: at the left margin, with a word for it or an opening brace and no assignment.
_BRACED_HEAD = re.compile(r"(?:[\w$]+ )*(?:class|enum|fn|func|function|impl|interface|namespace|procedure|struct|trait)\b|(?:const|let|var) [\w$]+ = (?:async )?(?:function\b|\(.*=>)|create\b|[^\s=;{}][^=;{}]*\{$", re.I)


def code_blocks(text: str) -> list[tuple[str, int]]:
    """(normal form, lines) of every definition that starts at the left margin or, in Python, one level in.

    Comments, strings alone on a line, blank lines and indentation are left out, so that a
    copy with another header, other docstrings or another layout has the same blocks.
    """
    lines = (_TRIPLE.sub("", text) if "'''" in text or '"""' in text else text).split("\n")
    python = any(x.startswith(_PYTHON_HEADS) and x.rstrip().endswith((":", "(", ",")) for x in lines)
    heads = _PYTHON_HEADS + _INNER_HEADS
    skipped = (*(("#",) if python else _COMMENTS), "'", '"', "import ", "from ", "@", "__")
    blocks: list[list[str]] = []
    for line in lines:
        bare = line.strip()
        if not bare or bare.startswith(skipped):
            continue
        margin = line[0] not in " \t"
        if line.startswith(heads) if python else margin and _BRACED_HEAD.match(bare):
            blocks.append([bare])
        elif blocks and (not margin or (not python and bare[0] in "})")):
            blocks[-1].append(bare)
    return [("\n".join(b), len(b)) for b in blocks if not (len(b) == 1 and b[0].startswith("class "))]


_ALNUM = bytes(x for x in range(128) if chr(x).isalnum())
_DEFINED = re.compile(r"def ([^\W_]*)\w*")
_CAPITAL = re.compile(r"[A-Z]\w*")
_LITERALS = re.compile(r"''(?:,? ?'')*,? ?")
_OPERATORS = "=+*/%<>,:;"
_LOOSE = [" " + x for x in "=+*/%<>"] + [x + " " for x in ",:;=+*/%<>"]
# In texts whose strings are emptied and whose digits are all one 0.
_LITERAL_LINE = re.compile(r"^(?=[^\n]*(?:''|0))(?:[bru]?''|0[xX][0a-fA-F]+|0(?:\.0)?(?:[eE][+-]?0)?|None|True|False|null|true|false|[ \t\[\](){},:;+-])+$", re.M)
_TABLE_ROW = re.compile(r"^[^\n]*(?:[|;\d]|,[^\n]*,)[^\n]*$", re.M)
# Bytes of UTF-8: whatever is not ASCII counts as part of a name.
_ONE_DIGIT = bytes.maketrans(b"123456789", b"000000000")
_NAMES = bytes(x if x > 127 or x in _ALNUM or x == 95 else 32 for x in range(256))
_NUMERALS = bytes(46 if x == 46 else _NAMES[x] for x in range(256))


def one_digit(raw: bytes) -> str:
    """A text in which every run of digits is a single 0."""
    out = raw.translate(_ONE_DIGIT)
    while b"00" in out:
        out = out.replace(b"00", b"0")
    return out.decode("utf-8", "replace")


def shapes(bare: str) -> Counter:
    """Lines of a text whose strings are emptied and digits are one, without what differs from one row or accessor to the next:

    class names and whatever follows a capital, repeated strings, and the end of a defined name.
    """
    out = _DEFINED.sub(r"def \1", bare) if "def " in bare else bare
    out = _LITERALS.sub("''", _CAPITAL.sub("N", out))
    return Counter(map(str.strip, out.split("\n")))


def statistics(text: str) -> dict:
    """All measures of one text."""
    n = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return {"n_lines": 0, "max_line": 0, "mean_line": 0.0, "space": 0.0, "alnum": 0.0, "number_density": 0.0, "encoded": 0.0, "literal_lines": 0.0, "tight": 0.0, "short_names": 0.0, "repeat": 0.0, "generated_header": False}
    many = len(lines)
    alnum = n - len(text.encode().translate(None, _ALNUM)) if text.isascii() else sum(map(str.isalnum, text))
    triple = "'''" in text or '"""' in text
    bare = _STRING.sub("''", text)
    code = _STRING.sub("''", _TRIPLE.sub("", text)) if triple else bare
    raw = code.encode("utf-8", "replace")
    names = [x for x in raw.translate(_NAMES).split() if x not in _KEYWORDS and not 48 <= x[0] < 58]
    numerals = [x for x in raw.translate(_NUMERALS).split() if 48 <= x[0] < 58]
    operators = sum(map(code.count, _OPERATORS))
    flat = code.replace("\n", " ")
    # Lines that hold nothing but literals, the rows of a table, also within one long string.
    plain = one_digit(bare.encode("utf-8", "replace"))
    literal = len(_LITERAL_LINE.findall(one_digit(raw) if triple else plain))
    if triple:
        literal += sum(len(_TABLE_ROW.findall(x)) for a, b in _TRIPLE.findall(text) if (x := a or b).count("\n") > 8)
    parts = text.split()
    encoded = sum(map(len, _RUN.findall(text))) if max(map(len, parts)) >= 48 else 0
    counted = shapes(plain)
    del counted[""]
    return {
        "n_lines": many,
        "max_line": max(map(len, lines)),
        "mean_line": sum(map(len, lines)) / many,
        "space": 1 - sum(map(len, parts)) / n,
        "alnum": alnum / n,
        "number_density": min(1.0, sum(map(len, numerals)) / n),
        "encoded": encoded / n,
        "literal_lines": min(1.0, literal / many),
        "tight": max(0.0, 1 - sum(map(flat.count, _LOOSE)) / operators) if operators >= 10 else 0.0,
        "short_names": sum(len(x) <= 2 for x in names) / len(names) if len(names) >= 10 else 0.0,
        "repeat": sum(k for _, k in counted.most_common(6)) / many,
        "generated_header": says_generated(text),
    }
