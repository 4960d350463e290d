from pyspark.sql import Row

from trawl.llm import licenses
from trawl.llm.license_public import FULL
from trawl.llm.license_texts import TEXTS

SCHEMA = "doc_id long, text string, digest string, _row int, `a.b` int"


def scanned(spark, texts):
    rows = [(i, t, "old", 1, 2) for i, t in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, SCHEMA), licenses.known_licenses(spark))
    assert found.columns == ["doc_id", "text", "_row", "a.b", "digest", "license", "line_licenses"]
    return [found_row for found_row in sorted(found.collect(), key=lambda r: r["doc_id"])]


def test_case_punctuation_copyright_lines_and_spellings_do_not_matter(spark):
    mit = TEXTS["MIT"]
    texts = [
        mit.upper(), "Copyright (c) 2019 A. Person\n" + mit, "# " + mit.replace("\n", "\n# "),
        mit.replace("sublicense", "sub-licence").replace(",", " ,  "), mit.replace("\n", " "),
        mit + "\n© 2020 Someone, all rights kept\n", mit.replace("free of charge", "at a price"),
        mit.replace("COPYRIGHT HOLDERS", "copyright owners"), mit.replace('"', "“")]
    assert [r["license"] for r in scanned(spark, texts)] == ["MIT"] * 6 + [None, "MIT", "MIT"]


def test_lines_and_empty_texts(spark):
    texts = ["words here\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
             None, "", " \n\t", "All rights reserved.", "the MIT License", "x" * 300_000]
    found = scanned(spark, texts)
    assert [r["line_licenses"] for r in found] == [["CC-BY-NC-4.0", "MIT"], [], [], [], ["all-rights-reserved"], [], []]
    assert [r["license"] for r in found] == [None, None, None, None, "all-rights-reserved", None, None]
    assert len({r["digest"] for r in found[1:4]}) == 1


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([Row(doc_id=1, text=TEXTS["ISC"])] * 3)
    assert [r["license"] for r in licenses.scan(rows, licenses.known_licenses(spark)).collect()] == ["ISC"] * 3
    assert licenses.scan(rows.limit(0), licenses.known_licenses(spark)).count() == 0


def test_full_texts_headings_and_list_marks(spark):
    full = {name: FULL[name] for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0",
                                          "Unlicense")}
    assert [r["license"] for r in scanned(spark, list(full.values()))] == list(full)
    mit, bsd = (TEXTS[name].split("\n\n", 1)[1] for name in ("MIT", "BSD-2-Clause"))
    starred = bsd.replace("1. ", "* ").replace("2. ", "* ")
    three = TEXTS["BSD-3-Clause"].replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) ")
    cut = FULL["GPL-3.0"].split("How to Apply These Terms")[0]
    texts = [mit, "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n" + mit, starred,
             "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + bsd, three, cut, mit + "\nand more", mit[:-30]]
    assert [r["license"] for r in scanned(spark, texts)] == [
        "MIT", "MIT", "BSD-2-Clause", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", None, None]


def test_one_licence_per_digest(spark):
    rows = licenses.known_licenses(spark).distinct().collect()
    assert len({r["digest"] for r in rows}) == len(rows)
