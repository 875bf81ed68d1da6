"""One nested document in parts: chunks, the scan over them, and malformed documents."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.schema import NODES
from plumbline.sources import report_tree, reports

STAT = "<statistic><mean>[1, 2, 3, 4]</mean><median>[1, 2, 3, 4]</median><deviation>[0.5, 0, 0, 0.5]</deviation></statistic>"
ITEM = '<entry item="{}"><mmcc> 1 </mmcc><tmcc>2</tmcc>\n<sif>nan</sif><lif>4</lif></entry>'


def documents():
    deep = 300
    many = "".join(f'<entry file="f{i}.c">{STAT}{"".join(ITEM.format(f"g{j}:{j}") for j in range(5))}</entry>' for i in range(40))
    good = f'<?xml version="1.0"?>\n<root><entry package="a &amp; b">{STAT}\n{many}</entry>\n</root>\n'
    return {
        "good": good,
        "single quotes": f"<root><entry package='p'>{STAT}<other x='1'><entry item='no'/></other></entry></root>",
        "deep": "<root>" + "".join(f'<entry package="p{i}">{STAT}' for i in range(deep)) + "</entry>" * deep + "</root>",
        "two roots": f'<root><entry package="a">{STAT}</entry><entry package="b">{STAT}</entry></root>',
        "two documents": f'<root><entry package="a">{STAT}</entry></root><root></root>',
        "no root entry": "<root></root>",
        "no type": '<root><entry other="a"/></root>',
        "no statistic": '<root><entry package="a"></entry></root>',
        "two statistics": f'<root><entry package="a">{STAT}{STAT}</entry></root>',
        "short statistic": f'<root><entry package="a">{STAT.replace("4]", "]", 1).replace("3, ", "", 1)}</entry></root>',
        "cut": good[: len(good) // 2],
        "not closed": good.replace("</root>", ""),
        "closed twice": good.replace("</root>", "</root></root>"),
        "crossed": good.replace("</entry>\n</root>", "</root></entry>"),
        "no document": "nothing < here",
    }


def write(folder, text, parts, rng):
    """The text cut anywhere behind tags into several files."""
    folder.mkdir()
    cuts = sorted(rng.sample([i + 1 for i, c in enumerate(text) if c == ">"], min(parts - 1, text.count(">"))))
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
        (folder / f"part-{number:05d}-x.txt").write_text(text[a:b])


@pytest.mark.parametrize("name", sorted(documents()))
def test_equals_whole_documents(spark, tmp_path, name):
    text = documents()[name]
    write(tmp_path / "doc", text, 3, random.Random(1))
    found = report_tree.read_report_tree(spark, str(tmp_path / "doc"), chunk=300)
    whole = reports.flatten_report(spark.createDataFrame([(1, text)], "doc_id int, xml string"))
    assert rows(found, *NODES.names) == rows(whole, *NODES.names)
    assert rows(found, F.col("error").isNull()) == rows(whole, F.col("error").isNull())


def test_the_scan_is_associative():
    rng = random.Random(3)
    text = documents()["good"].split("?>", 1)[1]
    for _ in range(50):
        cuts = sorted(rng.sample([i + 1 for i, c in enumerate(text) if c == ">"], 3))
        a, b, c, d = (report_tree.summary(t, "x") for t in (text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] : cuts[2]], text[cuts[2] :]))
        tags = lambda s: (s[0], [e[:3] for e in s[1]])
        both = report_tree.both
        left, right = both(both(both(a, b), c), d), both(a, both(b, both(c, d)))
        assert tags(left) == tags(right) == tags(both(both(a, b), both(c, d))) == ([], [])


def test_written_in_document_order(spark, tmp_path):
    """Parts in the order of their names are the document, whatever names sort like."""
    names = ["r", "r/a", "r/a b", "r/a-c", "r/a/x", "r/a/x/f", "r/a/y", "r/é"]
    nodes = spark.createDataFrame(
        [(n, "", 1, "item" if n == "r/a/x/f" else "package", *[1.0] * 12) for n in names], NODES
    ).repartition(5)
    report_tree.write_report_tree(nodes, str(tmp_path / "doc"))
    files = sorted(f for f in (tmp_path / "doc").iterdir() if f.name.startswith("part"))
    text = "".join(f.read_text() for f in files)
    found = reports.flatten_report(spark.createDataFrame([(1, text)], "doc_id int, xml string"))
    assert rows(found, "node_path") == sorted(((n,) for n in names), key=repr)
    back = report_tree.read_report_tree(spark, str(tmp_path / "doc"), F.lit(7))
    assert rows(back, "node_path", "doc_id") == sorted(((n, 7) for n in names), key=repr)
