import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from tessella.llm.license_texts import TEXTS
from tessella.llm import queries
from tessella.llm.licenses import TEMPLATES, TemplateIndex, license_matches, licenses

WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def bigrams(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(zip(w, w[1:], strict=False))


def brute(text, least=0.8):
    """Best run of lines for each template, by trying all of them."""
    lines, out = text.split("\n"), {}
    for name, template in TEMPLATES.items():
        wanted = bigrams(template)
        size = sum(wanted.values())
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                own = bigrams("\n".join(lines[i : j + 1]))
                n = sum(own.values())
                dice = 2 * sum((own & wanted).values()) / (n + size) if n + size else 0
                if dice >= least and dice > out.get(name, 0):
                    out[name] = dice
    return out


def wrapped(text, width=70):
    return "\n".join(x.strip() for x in re.findall(rf".{{1,{width}}}(?: |$)", text))


def test_against_all_runs():
    texts = [
        "intro words here\nReleased under the MIT License.\nmore words",
        "Copyright (c) 2020 Somebody\n\n" + wrapped(TEMPLATES["MIT"]) + "\n\nrest of it",
        wrapped(TEMPLATES["Apache-2.0-header"], 40),
        TEMPLATES["ISC"].replace("software", "library"),
        "Licensed under the Apache License,\nVersion 2.0.",
        "under the the the of in",
    ]
    index = TemplateIndex(TEMPLATES, 0.8)
    found = [{} for _ in texts]
    for row, name, dice, _, _ in index.scan(pa.array(texts, pa.large_string())):
        found[row][name] = dice
    for text, own in zip(texts, found, strict=True):
        assert own == brute(text)
    assert "MIT" in found[1] and "ISC" in found[3] and not found[5]


def test_queries_find_the_planted_lines(spark, sf, docs):
    found = {r.doc_id for r in license_matches(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert found == set(docs.doc_id[docs.text.str.contains("(?i)licen[cs]e")]) and found


def test_edges(spark, edge_docs, empty_docs):
    assert license_matches(edge_docs).count() == 0
    assert license_matches(empty_docs).count() == 0
    rows = spark.createDataFrame([(1, "MIT"), (None, "Released under the MIT License."), (2, None), (3, "Released under the MIT License.\n" * 2000)], "doc_id long, text string")
    found = license_matches(rows.selectExpr("*", "'clash' as license", "'clash' as dice")).collect()
    assert {(r.doc_id, r.license, r.dice) for r in found} == {(None, "MIT-notice", 1.0), (3, "MIT-notice", 1.0)}
    assert license_matches(rows, {"one": "word", "none": ""}).count() == 0


def test_licenses_inside_long_lines():
    before, after = "All source files in this project are ", " Ask the maintainers of the project about anything else."
    texts = [
        before + TEMPLATES["Apache-2.0-notice"],
        "x " * 3000 + TEMPLATES["MIT"] + " and " + "y z " * 3000,
        '{"license": "' + TEMPLATES["ISC"] + '", "name": "' + "a b " * 200 + '"}\n' + before + TEMPLATES["MIT-notice"] + after,
        (before + TEMPLATES["MIT-notice"] + after) * 3,
        before + TEMPLATES["Apache-2.0-header"] + after,
    ]
    found = [[] for _ in texts]
    for row, name, dice, first, last in TemplateIndex(TEMPLATES, 0.8).scan(pa.array(texts, pa.large_string())):
        found[row].append((name, dice, first, last))
    assert found == [
        [("Apache-2.0-notice", 1.0, 0, 0)],
        [("MIT", 1.0, 0, 0)],
        [("ISC", 1.0, 0, 0), ("MIT-notice", 1.0, 1, 1)],
        [("MIT-notice", 1.0, 0, 0)] * 3,
        [("Apache-2.0-header", found[4][0][1], 0, 0)],
    ]


def test_word_windows_against_all_runs():
    """Where whole lines are too long, the best window is the best of all pairs of words."""
    words = "released under the mit license see under the mit file released the license under".split()
    text = " ".join(words * 2)
    wanted = bigrams(TEMPLATES["MIT-notice"])
    size, own = sum(wanted.values()), text.split()
    best = max(
        2 * sum((bigrams(" ".join(own[i:j])) & wanted).values()) / (j - i - 1 + size) for i in range(len(own)) for j in range(i + 2, len(own) + 1)
    )
    found = TemplateIndex({"MIT-notice": TEMPLATES["MIT-notice"]}, 0.5).matches(pa.array([text], pa.large_string()))
    assert max(x.dice for x in found) == best == 1.0 and len({x.first for x in found}) == len(found) >= 2


def heaviest(texts):
    found = [[] for _ in texts]
    for x in TemplateIndex(TEMPLATES, 0.8).matches(pa.array(texts, pa.large_string())):
        found[x.row].append((x.weight, x.license))
    return [max(x, default=(0, None))[1] for x in found]


def shapes(text):
    """A text with a copyright line, in lines of 60, as one line for each paragraph and as one line among others."""
    paragraphs = [" ".join(x.split()) for x in text.split("\n\n")]
    top = "Copyright (c) 2020 Somebody"
    return ["\n\n".join([top, *(wrapped(x, 60) for x in paragraphs)]), "\n\n".join([top, *paragraphs]), "a b " * 3000 + " ".join(text.split()) + " c d" * 3000]


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_whole_texts(name):
    assert heaviest(shapes(TEXTS[name])) == [name] * 3


def test_texts_of_this_machine():
    files = {"BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"} | {x: x for x in ("Apache-2.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    there = {Path("/usr/share/common-licenses", k): v for k, v in files.items() if Path("/usr/share/common-licenses", k).exists()}
    for path, name in there.items():
        assert heaviest(shapes(path.read_text())) == [name] * 3
    gpl_2 = TEXTS["GPL-2.0"]
    assert heaviest([gpl_2[gpl_2.index("TERMS AND CONDITIONS") : gpl_2.index("END OF TERMS")]]) == ["GPL-2.0"]


def test_versions_of_headers():
    index = TemplateIndex(TEMPLATES, 0.8)
    for name in ("GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header"):
        found = index.scan(pa.array([wrapped(TEMPLATES[name], 60)], pa.large_string()))
        best = max(found, key=lambda x: x[2])
        assert best[1:3] == (name, 1.0)


def test_query_returns_every_license(spark, tmp_path):
    mit, apache, gpl_2 = (TEMPLATES[x] for x in ("MIT-notice", "Apache-2.0-notice", "GPL-2.0-notice"))
    rows = [
        (1, f"{mit}\nwords between\n{apache}"),
        (2, f"Dual licensed. {mit} {apache} Pick one of both of these at your own will, whichever suits you most."),
        (3, gpl_2),
        (None, mit),
        (None, apache),
        (4, mit),
        (4, gpl_2),
        (4, mit),
        (5, wrapped(TEMPLATES["Apache-2.0"]) + "\n" + wrapped(TEMPLATES["MIT"])),
        (6, f"{gpl_2}\nand parts of it:\n" + gpl_2.replace("version 2", "version 3")),
        (7, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_license_scan(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.license) for r in found) == Counter(
        [(1, "MIT-notice"), (1, "Apache-2.0-notice"), (2, "MIT-notice"), (2, "Apache-2.0-notice"), (3, "GPL-2.0-notice"), (None, "MIT-notice")]
        + [(None, "Apache-2.0-notice"), (4, "MIT-notice"), (4, "MIT-notice"), (4, "GPL-2.0-notice"), (5, "Apache-2.0"), (5, "MIT")]
        + [(6, "GPL-2.0-notice"), (6, "GPL-3.0-notice")]
    )
    here = {x.license for x in TemplateIndex(TEMPLATES, 0.8).matches(pa.array([gpl_2], pa.large_string()))}
    assert {r.n_templates for r in found if r.doc_id == 3} == {len(here)} != {1}


def test_edges_of_all_licenses(spark, edge_docs, empty_docs):
    assert licenses(edge_docs).count() == licenses(empty_docs).count() == 0
    assert licenses(edge_docs.limit(0), {"one": "word", "none": ""}).count() == 0
