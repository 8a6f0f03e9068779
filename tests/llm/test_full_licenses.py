"""Documents that are a whole public licence."""

import re
import textwrap

import pytest

from tidelog.llm import license_texts, licenses


def test_whole_licences_are_found(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    texts = [license_texts.TEXTS[n] for n in names]
    rows = [(n, t) for n, t in zip(names, texts)] + [(n, "\n".join(f"#   {x}" for x in t.splitlines())) for n, t in zip(names, texts)]
    rows += [("none", t[: len(t) // 2]) for t in texts]
    found = licenses.find_licenses(spark.createDataFrame(rows, "name string, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["license_id"] == (None if r["name"] == "none" else r["name"])


@pytest.mark.parametrize("name, words", [("Apache-2.0", 1500), ("GPL-3.0", 5000), ("Unlicense", 190), ("CC0-1.0", 1000)])
def test_texts_are_whole(name, words):
    assert len(license_texts.TEXTS[name].split()) > words

WIDTHS = (40, 46, 50, 56, 60, 66, 72, 76, 79, 100)
MARKS = ("", "# ", " * ", "// ", "; ")


def wrapped(text, width, mark=""):
    """The paragraphs of a text wrapped anew, each line behind a comment mark."""
    lines = []
    for part in re.split(r"\n[ \t]*\n", text):
        lines += [*textwrap.wrap(" ".join(part.split()), width, break_long_words=False), ""]
    return "\n".join(mark + x for x in lines)


def test_licences_wrapped_anew_are_found(spark):
    """Wherever lines break, also with a notice of the holder's own; another text of the same form may lend its id."""
    ids = {r["license_digest"]: r["license_id"] for r in licenses.known_digests(spark, notices=True).collect()}
    rows = [(n, w, wrapped(t, w, MARKS[k % len(MARKS)])) for n, t in license_texts.TEXTS.items() for k, w in enumerate(WIDTHS)]
    short = [n for n, t in license_texts.TEXTS.items() if len(t) < 2000 and "copyright (c)" not in t.lower()]
    notices = ["Copyright (c) 2020 Some Holder", "Copyright Some Holder and contributors", "© Some Holder", "(c) 1999, 2004 Holder\nAll rights reserved.", "COPYRIGHT: 2021 HOLDER"]
    rows += [(n, w, f"{MARKS[k % 5]}{notices[(k // 5) % 5]}\n\n".replace("\nAll", f"\n{MARKS[k % 5]}All") + wrapped(license_texts.TEXTS[n], w, MARKS[k % 5])) for n in short for k, w in enumerate(WIDTHS)]
    rows.append(("none", 0, wrapped(license_texts.TEXTS["Apache-2.0"], 60).replace("copyright license", "license", 1)))
    out = licenses.find_licenses(spark.createDataFrame(rows, "name string, width int, text string")).collect()
    same = dict.fromkeys(license_texts.TEXTS)
    for r in licenses.find_licenses(spark.createDataFrame(list(license_texts.TEXTS.items()), "name string, text string")).collect():
        same[r["name"]] = r["license_id"]
    assert set(same.values()) <= set(ids.values())
    assert [(r["name"], r["width"], r["license_id"]) for r in out if r["license_id"] != same.get(r["name"])] == []


def test_sentences_and_items_are_no_notices(spark):
    """A line that begins with "copyright" in a sentence, or with "(c)" in a list, stays."""
    known = licenses.known_digests(spark, {"x": "Grant of\ncopyright license to all.\n(c) You must retain this.\nHolders have all rights reserved\nby law."}, notices=True)
    rows = [(1, "grant of copyright\nlicense to all. (c) You must retain this. Holders have\nall rights reserved by law"), (2, "grant of license to all. you must retain this. holders have by law"), (3, "grant of")]
    out = licenses.find_licenses(spark.createDataFrame(rows, "doc_id int, text string"), known).orderBy("doc_id").collect()
    assert [r["license_id"] for r in out] == ["x", None, None]
