from __future__ import annotations

import random

from graphmill.llm import handwritten, layout

HAND = '''"""Opens the archive and lists what it holds."""
import os


class Archive:
    """One archive on disk."""

    def __init__(self, path, limit=None):
        self.path = os.path.abspath(path)
        self.limit = limit or 100

    def entries(self):
        found = []
        for name in sorted(os.listdir(self.path)):
            if name.startswith("."):
                continue
            found.append(name)
            if len(found) >= self.limit:
                break
        return found

    def largest(self):
        sizes = {name: os.path.getsize(os.path.join(self.path, name)) for name in self.entries()}
        return max(sizes, key=sizes.get) if sizes else None
'''
LIBRARY = "".join(f"def shared_{i}(a, b):\n    total = a * {i} + b\n    if total > {i}:\n        return total\n    return {i}\n\n" for i in range(3)).replace("total >", "total >=", 1)
ACCESSORS = "class Frame:\n" + "".join(f"    def field_{i:03}(self):\n        return self.read({4 * i}, 4)\n\n" for i in range(30))
JS = """// Opens and closes the menu of a page.
export class Menu {
  constructor(root) {
    this.root = root;
    this.open = false;
  }

  toggle(event) {
    event.preventDefault();
    this.open = !this.open;
    this.root.classList.toggle("open", this.open);
  }
}

export function attach(selector) {
  const found = document.querySelectorAll(selector);
  for (const element of found) {
    const menu = new Menu(element);
    element.addEventListener("click", (event) => menu.toggle(event));
  }
  return found.length;
}
"""
JS_LIBRARY = "".join(f"function shared{i}(left, right) {{\n  const total = left * {i} + right;\n  if (total > {i}) {{\n    return total;\n  }}\n  return {i};\n}}\n\n" for i in range(3))
CSS = """/* Colours of the page. */
body {
  margin: 0;
  color: #222;
}

.menu {
  display: none;
  position: absolute;
}

.menu.open {
  display: block;
}
"""
FILES = {
    "app/archive.py": (HAND, "hand"),
    "app/empty.py": ("", "empty"),
    "app/blank.py": (" \n\n", "empty"),
    "third_party/fastlib/core.py": (LIBRARY, "vendored"),
    "app/helpers/core.py": ('"""Our helpers."""\n# moved here\n' + LIBRARY, "vendored"),
    "vendor_orders/list.py": (HAND.replace("Archive", "Orders"), "hand"),
    "app/stub.py": ("# Code generated by wiregen. DO NOT EDIT.\nX = 1\n", "generated"),
    "app/writer.py": ('"""Writes the stubs; edit freely."""\nBANNER = "# Code generated by wiregen. DO NOT EDIT."\n' + HAND, "hand"),
    "app/frame.py": (ACCESSORS, "generated"),
    "app/small.py": (";".join(f"{c}={c}+{i}" for i, c in enumerate("abcdefghij" * 12)), "minified"),
    "app/font.py": ("FONT = (\n" + "".join(f"    b'{'Qk9/+x' * 12}{i}'\n" for i in range(20)) + ")\n", "data"),
    "app/weights.py": ("W = [\n" + "".join(f"    {i}.25, -{i}.5, {i}e0,\n".replace("e0", ".0") for i in range(20)) + "]\n", "data"),
    "app/own_rights.py": ("# Copyright (c) The Harbour Authors\n# Licensed under the Harbour licence; see the upstream repository.\n" + HAND.replace("Archive", "Harbour"), "hand"),
    "app/asks.py": ("# Do not edit the limits without asking.\n# Written by Ada from an older script.\n" + HAND.replace("Archive", "Limits"), "hand"),
    "app/german.py": ("# Automatisch erzeugt aus felder.xml. Bitte nicht bearbeiten.\nX = 2\n", "generated"),
    "web/client.js": ("// Code generated by wiregen. DO NOT EDIT.\nexport const x = 1;\n", "generated"),
    "web/theme.css": ("/* @generated from theme.scss */\n.a { color: red; }\n", "generated"),
    "web/tables.sql": ("-- This file was produced by the modeller, changes will be lost.\nCREATE TABLE a (b int);\n", "generated"),
    "web/menu.js": (JS, "hand"),
    "web/menu_copy/menu.ts": ("/* ours */\n" + JS_LIBRARY, "vendored"),
    "node_modules/tiny/index.js": (JS_LIBRARY, "vendored"),
    "web/menu.min.js": ("".join(f"function q{i}(a,b){{return a+b*{i}}}var z{i}=q{i}(1,2);" for i in range(30)), "minified"),
    "web/page.css": (CSS, "hand"),
    "web/small.css": ("".join(f".a{i}{{margin:0;padding:{i}px;color:#fff}}" for i in range(40)), "minified"),
    "web/query.sql": ("-- Orders that wait.\nSELECT o.id, o.placed\nFROM orders AS o\nJOIN customers AS c ON c.id = o.customer\nWHERE o.state = 'open'\nORDER BY o.placed;\n", "hand"),
    "web/seed.sql": ("".join(f"  ({i}, 'row {i}', NULL, {i}.5),\n".replace("NULL", "null") for i in range(40)), "data"),
    "app/rules.py": ("RULES = r'" + "|".join(f"(?P<a{i}>x[a-z]{{{i}}})" for i in range(60)) + "'\n" + HAND, "hand"),
}


def test_verdicts(spark):
    tree = [("r", p, f"SHA{i}" if i % 2 else f"sha{i}", "extra") for i, p in enumerate(FILES)]
    tree += [("r2", "./app/archive.py", "sha0", ""), ("r", "app/none.py", None, ""), ("r", None, "sha0", ""), ("r", "app/none.py", "", ""), ("r", "node_modules/x.py", "missing", "")]
    texts = [(f"sha{i}", t) for i, (t, _) in enumerate(FILES.values())]
    df = handwritten.classify_files(spark.createDataFrame(tree, "rev string, path string, blob_sha string, verdict string"), spark.createDataFrame([*texts, texts[0], ("sha1", None), (None, "x")], "blob_sha string, content string"))
    got = {r.path: r.verdict for r in df.collect()}
    assert got == {p: v for p, (_, v) in FILES.items()} | {"node_modules/x.py": "vendored"}
    assert df.count() == len(got)


def test_empty_tables(spark):
    none = handwritten.classify_files(spark.createDataFrame([], "path string, blob_sha string"), spark.createDataFrame([], "blob_sha string, content string"))
    assert none.count() == 0


def test_statistics_of_odd_texts():
    draw = random.Random(4)
    for text in ["", "\n", "'", '"""', "'''" * 3, "x" * 300_000, "\x00\udcff".encode("utf-8", "replace").decode(), "é" * 50, *("".join(draw.choice("ab =+'\"\n#(){}1.,\\") for _ in range(400)) for _ in range(200))]:
        x = layout.statistics(text)
        assert set(x) == set(handwritten._MEASURES) and all(0 <= x[k] <= 1 for k in ("space", "alnum", "tight", "short_names", "literal_lines", "repeat", "encoded"))
        layout.code_blocks(text)


def test_headers_by_language():
    assert layout.header_lines("#!/bin/x\n\n# one\n'''two\nthree'''\nx = 1\n# four\n") == ["#!/bin/x", "# one", "two", "three"]
    assert layout.header_lines("// a\n/* b\n * c */\nlet x\n// d") == ["// a", "b", "c"]
    assert layout.header_lines("<!-- a -->\n-- b\nselect 1") == ["a", "-- b"]
    assert layout.header_lines("/* never closed") == ["never closed"] and layout.header_lines("") == []
    for said in ("# @generated by x", "// Code generated by x. DO NOT EDIT.", "/* auto-generated file */", "-- Generated by the writer on 1-2-3", "# x: machine output, rerun y instead of editing it", "# Ce fichier est généré, ne pas modifier"):
        assert layout.says_generated(said), said
    for said in ("# Do not edit this by hand", "# How reports are generated", "# Never change the order that was generated here" * 0, '"""Finds files headed: Code generated by x."""', "x = 1\n# @generated"):
        assert not layout.says_generated(said), said


def test_texts_of_one_sha_and_copies_in_other_languages(spark):
    texts = spark.createDataFrame([("aa", ""), ("AA", HAND), ("aa", None), ("bb", "x"), ("bb", "x")], "blob_sha string, content string")
    got = {r.blob_sha: r.n_lines for r in handwritten.text_statistics(texts).collect()}
    assert got == {"aa": len([x for x in HAND.split("\n") if x.strip()]), "bb": 1}
    assert [n for _, n in layout.code_blocks(JS_LIBRARY)] == [7, 7, 7] == [n for _, n in layout.code_blocks("// moved\n" + JS_LIBRARY.replace("  ", "\t"))]
