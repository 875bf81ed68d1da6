import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.functions.naming import canonize_name, decanonize_name, parent_of
from plumbline.functions.patterns import find_regex, glob_to_regex, in_range
from plumbline.functions.source_batch import function_metrics, groups, measure
from plumbline.operators import metrics, tree, view
from plumbline.plans import chains
from plumbline.sources import files, reports, sinks

FOO = "int foo(int a)\n{\n    if (a % 2)\n    {\n        return 1;\n    }\n    else\n    {\n        return 0;\n    }\n}\n"
BAR = "int bar(int a)\n{\n    return !foo(a);\n}\n"
MAIN = "#include <iostream>\n\nint main(int argc, char **argv)\n{\n    std::cout << \"hi\" << std::endl;\n    return 0;\n}\n"


@pytest.fixture()
def tree_folder(tmp_path):
    for name, text in {
        "src/foo.cpp": FOO,
        "src/deep/bar.c": BAR,
        "main.cpp": MAIN,
        "build/gen.cpp": BAR,
        "thirdparty/x.h": BAR,
        "notes.txt": "int f() {}",
    }.items():
        path = tmp_path / "project" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "project")


def test_read_and_select_sources(spark, tree_folder):
    assert files.read_sources(spark, tree_folder).where("path LIKE 'project/%'").count() == 6
    sources = files.read_sources(spark, tree_folder, package="")
    assert sources.count() == 6
    kept = files.select_sources(sources)
    assert rows(kept, "path") == [("main.cpp",), ("src/deep/bar.c",), ("src/foo.cpp",)]
    assert kept.where("path = 'src/foo.cpp'").first().content == FOO
    assert files.read_sources(spark, tree_folder, "*.c").count() == 1


def test_fixture_metrics(spark, tree_folder):
    leaves = metrics.code_metrics(files.select_sources(files.read_sources(spark, tree_folder)))
    assert rows(leaves, "item", "mmcc", "tmcc", "sif", "lif") == [
        ("bar:1", 1, 1, 1, 4),
        ("foo:1", 2, 2, 3, 11),
        ("main:3", 1, 1, 2, 5),
    ]


def test_code_metrics_keeps_extra_columns(spark):
    texts = spark.createDataFrame([(3, "a.c", BAR), (4, "a.c", None)], "snapshot int, path string, content string")
    assert rows(metrics.code_metrics(texts, ["snapshot"]), "snapshot", "path", "item") == [(3, "a.c", "bar:1")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("int f(int a) { switch (a) { case 1: case 2: return 1; default: return 0; } }", [("f", 2, 3, 3)]),
        ("int f(int a) { return a && b || c ? 1 : 2; }", [("f", 4, 4, 1)]),
        ("int f(int a) { do { a--; } while (a); for (;;) ; }", [("f", 3, 3, 4)]),
        ('int f() { /* if while */ // for\n return "if (" == x; }', [("f", 1, 1, 1)]),
        ('void f() { auto s = R"x( } if " )x"; char c = \'}\'; }', [("f", 1, 1, 2)]),
        ("int f(int); int x = g(1); int a[] = {1, 2};", []),
        ("namespace n { struct S { S(int x) : y{x}, z(x) { go(); } ~S() {} }; }", [("S", 1, 1, 1), ("~S", 1, 1, 0)]),
        ("bool A::operator==(const A& o) const { return true; }", [("A::operator==", 1, 1, 1)]),
        ("void A::operator()(int q) noexcept { q++; }", [("A::operator()", 1, 1, 1)]),
        ("template <class T> int ns::f(T a) { return 1; } int ns::f(int) { return 2; }", [("ns::f", 1, 1, 1)] * 2),
        ("#define F(x) { if (x) }\nint g() { return 1; }", [("g", 1, 1, 1)]),
        ("class C { public: int f() { return 1; } private: int g() { return 2; } };", [("f", 1, 1, 1), ("g", 1, 1, 1)]),
        ("int f() { return 1'000; } int g() { unclosed(", [("f", 1, 1, 1), ("g", 1, 1, 0)]),
    ],
)
def test_counting_rules(text, expected):
    assert [(name, m, t, s) for name, _, m, t, s, *_ in function_metrics(text)] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("#if A\nint f(int a)\n{\n#else\nint f(long a)\n{\n#endif\n return a;\n}\nint g() { return 1; }", ["f", "g"]),
        ("#ifdef A\n#if B\nint f() {\n#else\nint h() {\n#endif\n}\n#elif C\n}}}\n#else\n{{\n#endif\nint g() {}", ["f", "g"]),
        ("int f(a, b) int a; char *b; { return a; } int g() { return 1; }", ["f", "g"]),
        ("MACRO(a) int x; int g() { return 1; }", ["g"]),
        ("void f(std::vector<int> v = {1, 2}, int w = 3) { if (w) go(); } int g() {}", ["f", "g"]),
        ("int f() try { return 1; } catch (const E& e) { return 2; } catch (...) { if (x) y(); } int g() {}", ["f", "g"]),
        ("struct S { operator bool() const { return 1; } operator const char*() { return 0; } };", ["operator bool", "operator const char*"]),
        ("void* operator new(size_t n) { return m(n); } void operator delete[](void* p) { q(p); }", ["operator new", "operator delete[]"]),
        ("S::operator std::string() { return s; } S& S::operator=(const S& o) { return *this; }", ["S::operator std::string", "S::operator="]),
    ],
)
def test_names_of_all_functions(text, expected):
    assert [name for name, *_ in function_metrics(text)] == expected


def test_words_for_operators_and_functions_that_return_functions():
    (f,) = function_metrics("int (*fp(int a))(int) { return a and b or c; }")
    assert f[:3] == ("fp", 1, 3)
    assert function_metrics("int (*fp)(int) = {g}; int (&h())[3] { return x; }")[0][0] == "h"
    assert function_metrics("int f() { band = 1; nor(x); return a or_b; }")[0][2] == 1
    assert function_metrics("class A (&&) { int f(int(*g)(int)) { return 1; } };")[0][0] in ("A", "f")


def test_batches_equal_single_texts():
    """Counts of a text do not depend on the texts around it."""
    rng = random.Random(5)
    bits = ["int f", "(", ")", "{", "}", ";", "=", "\n", "if (a) ", "while (b) ", "while (c);", "for (;;) ", "case 1:", "&&", "|||",
            "? :", "class A ", "try ", "catch (E e) {", "#if A\n", "#else\n", "#endif\n", "int a;", "a, b", "é", "i", "f", "while"]
    texts = [FOO, BAR, "", MAIN] + ["".join(rng.choices(bits, k=rng.randint(0, 50))) for _ in range(600)]
    found = measure(texts)
    columns = ("line", "mmcc", "tmcc", "sif", "lif", "incomplete")
    together = list(zip(found["text"].tolist(), found["name"], *(found[c].tolist() for c in columns)))
    assert together == [(i, *f) for i, text in enumerate(texts) for f in function_metrics(text)]
    assert sum(len(texts[g]) for g in groups(texts)) == len(texts)


def test_time_is_linear():
    """Many parameters of an old-style function, many initialisers, deep braces."""

    def seconds(n: int) -> float:
        old = f"int f({','.join(f'p{i}' for i in range(n))}) {' '.join(f'int p{i};' for i in range(n))} {{ return 1; }}\n"
        lists = "int " + ", ".join(f"a{i}[] = {{1}}" for i in range(n)) + ";\n"
        deep = "int g() " + "{ if (x) " * n + "}" * n
        began = time.perf_counter()
        assert [f[0] for f in function_metrics(old + lists + deep)] == ["f", "g"]
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(8000) for _ in range(3)) < 8 * min(seconds(2000) for _ in range(3))


def test_default_argument_and_handlers_count():
    (f, *_), _ = function_metrics("void f(V v = {1, 2}, int w = 3) { if (w) go(); } int g() {}")
    assert list(function_metrics("void f(V v = {1}) { if (w) go(); }"))[0][2:5] == (2, 2, 2)
    assert list(function_metrics("int f() try { a(); } catch (...) { if (x) y(); }"))[0][2:5] == (2, 2, 3)


def test_a_body_without_end_is_marked(spark):
    texts = spark.createDataFrame([("a.c", "int f() { return 1; } int g() { if (x) {")], "path string, content string")
    found = metrics.code_metrics(texts, incomplete=True)
    assert rows(found, "item", "mmcc", "incomplete") == [("f:1", 1, False), ("g:1", 2, True)]


def test_lines_of_later_functions():
    text = BAR + "\n\n" + FOO
    assert [(name, line, lif) for name, line, _, _, _, lif, _ in function_metrics(text)] == [("bar", 1, 4), ("foo", 7, 11)]


def test_filter_metric_ranges(spark):
    leaves = spark.createDataFrame([(1, 1, 1, 1), (5, 5, 5, 5), (10, 10, 10, 10)], "mmcc long, tmcc long, sif long, lif long")
    assert rows(metrics.filter_metric_ranges(leaves), "mmcc") == [(1,), (10,), (5,)]
    assert rows(metrics.filter_metric_ranges(leaves, mmcc="5,10", lif=",9"), "mmcc") == [(5,)]
    assert rows(metrics.filter_metric_ranges(leaves, mmcc="5,*"), "mmcc") == [(10,), (5,)]
    assert leaves.where(in_range(F.col("mmcc"), "5,5")).count() == 1


NAMES = ["a", "ns::f", "ns::f:12", "f:12", "op<", "a/b", "a|b*?", "%colon%", "x\\y>"]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    safe = {r.n: r.c for r in df.select("n", canonize_name("n").alias("c")).collect()}
    assert safe == {
        "a": "a",
        "ns::f": "ns%colon%%colon%f",
        "ns::f:12": "ns%colon%%colon%f+12",
        "f:12": "f+12",
        "op<": "op%left-angle-bracket%",
        "a/b": "a%slash%b",
        "a|b*?": "a%pipe%b%asterisk%%question%",
        "%colon%": "%colon%",
        "x\\y>": "x%backslash%y%right-angle-bracket%",
    }
    back = {r.n: r.c for r in df.select("n", decanonize_name(canonize_name("n")).alias("c")).collect()}
    for name in NAMES:
        if name.count(":") % 2 == 0 and "%" not in name:
            assert back[name] == name
    assert back["f:12"] == "f+12" and back["%colon%"] == ":"


def test_patterns():
    import re

    assert find_regex(r".*\.\(hpp\|cpp\|c\|h\)") == r".*\.(hpp|cpp|c|h)"
    assert find_regex("a(b)|c") == r"a\(b\)\|c"
    for glob, text, hit in [
        ("*buil*", "x/build/y", True),
        ("*.c", "a/b.c", True),
        ("?.c", "ab.c", False),
        ("[!a]x", "bx", True),
        ("[a-c]x", "dx", False),
        ("a.c", "abc", False),
        ("[", "[", True),
    ]:
        assert bool(re.search(glob_to_regex(glob), text)) is hit, glob


def node_report(spark, docs):
    return reports.flatten_report(spark.createDataFrame(docs, "doc_id long, xml string"))


STAT = "<statistic><mean>[1, 2.5, 3, nan]</mean><median>[1,2,3,4]</median><deviation>[0,0,0,0.5]</deviation></statistic>"


def test_flatten_report(spark):
    good = (
        f'<root><entry package="src">{STAT}<entry file="a.c">{STAT}<entry item="ns::f:3"><mmcc> 1 </mmcc><tmcc>2</tmcc>'
        "<sif>3</sif><lif>4</lif></entry></entry></entry></root>"
    )
    bad = {
        2: "<root><entry package='a'/><entry package='b'/></root>",
        3: "<root><entry other='a'/></root>",
        4: "<root><entry package='a'></entry></root>",
        5: "<root><entry",
    }
    flat = node_report(spark, [(1, good), *bad.items()])
    assert rows(flat.where("doc_id = 1"), "node_path", "parent_path", "depth", "node_type", "mmcc", "lif", "lif_deviation") == [
        ("src", "", 1, "package", 1.0, None, 0.5),
        ("src/a.c", "src", 2, "file", 1.0, None, 0.5),
        ("src/a.c/ns%colon%%colon%f+3", "src/a.c", 3, "item", 1.0, 4.0, None),
    ]
    broken = flat.where("doc_id > 1")
    assert broken.count() == 4 and broken.where("error IS NULL OR node_path IS NOT NULL").count() == 0


def test_deep_report(spark):
    depth = 3000
    xml = "<root>" + "".join(f'<entry package="p{i}">{STAT}' for i in range(depth)) + "</entry>" * depth + "</root>"
    assert node_report(spark, [(1, xml)]).agg(F.max("depth")).first()[0] == depth


def test_report_sinks(spark, tree_folder, tmp_path):
    leaves, stats, params = chains.statistic(files.read_sources(spark, tree_folder, package=""))
    entries = reports.report_entries(tree.to_counter_row(leaves, stats), params)
    reports.write_report(entries, str(tmp_path / "xml"))
    reports.write_report(entries, str(tmp_path / "json"), "json")
    back = spark.read.format("xml").option("rowTag", "entry").load(str(tmp_path / "xml"))
    assert back.count() == entries.count()
    assert back.where("_path = 'src'").select("statistic.mean").first()[0] == "[1.5, 1.5, 2.0, 7.5]"
    assert spark.read.json(str(tmp_path / "json")).where("_path = 'src'").select(F.size("params")).first()[0] == 2


def test_view_sinks(spark, tree_folder, tmp_path):
    folded = chains.view(files.read_sources(spark, tree_folder, package=""), attrs="mmcc,lif")
    sinks.write_folded(folded, str(tmp_path / "folded"))
    assert rows(spark.read.text(str(tmp_path / "folded")))[:2] == [("main.cpp;main:3;lif 5",), ("main.cpp;main:3;mmcc 1",)]
    wide = spark.createDataFrame([(2, None), (1, 0.5)], 'TIME long, `a["x"]` double')
    sinks.write_view_csv(wide, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect() if not r.value.startswith("TIME")]
    assert sorted(lines) == ["1,0.5", "2,nan"]
    header = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect() if r.value.startswith("TIME")]
    assert set(header) == {'TIME,"a[""x""]"'}


def test_read_catalog(spark, tmp_path):
    folder = tmp_path / "api" / "service_a"
    folder.mkdir(parents=True)
    (folder / "req_1.json").write_text(
        '{"Method": "GET",\n "Query": "+/x", "Params": {"-a": "1", "nested": {"-b": "2"}}, "Content-Type": "text/plain"}'
    )
    found = files.read_catalog(spark, str(tmp_path / "api")).first()
    assert (found.service, found.name, found.method, found.query, found.content_type) == (
        "service_a", "req_1", "GET", "+/x", "text/plain")
    assert found.params == {"-a": "1", "nested": '{"-b": "2"}'}


def leaves_of(spark, data):
    df = spark.createDataFrame(data, "path string, item string, mmcc long, tmcc long, sif long, lif long")
    return tree.with_leaf_path(df)


def test_rollup_and_params(spark):
    leaves = leaves_of(spark, [("/r/a/x.c", "f:1", 1, 2, 3, 4), ("r/a/x.c", "g:9", 3, 2, 5, 10), ("r//y.c", "h:1", 8, 8, 8, 8)])
    stats = {r.node_path: r for r in tree.rollup_stats(leaves).collect()}
    assert set(stats) == {"r", "r/a", "r/a/x.c", "r/y.c"}
    root = stats["r"]
    assert (root.n_leaves, root.node_type, root.depth, root.mmcc_mean, root.mmcc_median) == (3, "package", 1, 4.0, 3.0)
    assert root.mmcc_deviation == pytest.approx(2.943920288775949)
    assert (stats["r/a"].lif_mean, stats["r/a"].lif_median, stats["r/a"].lif_deviation) == (7.0, 7.0, 3.0)
    assert stats["r/y.c"].sif_deviation == 0.0
    chunks = tree.leaf_params(leaves, chunk_size=1)
    flat = chunks.select("node_path", F.inline("params"))
    assert flat.where("node_path = 'r'").count() == 3
    assert chunks.where("node_path = 'r'").first().n_chunks == 3
    one = tree.leaf_params(leaves).where("node_path = 'r/a'").first()
    assert [p.item for p in one.params] == ["r/a/x.c/f+1", "r/a/x.c/g+9"]


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_chunks_are_full_and_in_order(spark, size):
    """One node holds nearly all leaves, over many range partitions."""
    leaves = leaves_of(spark, [(f"p/{'hot' if i % 50 else 'd'}/f{i % 3}.c", f"f:{i}", i, 1, 1, 1) for i in range(900)])
    chunks = tree.leaf_params(leaves, chunk_size=size)
    whole = {}
    for r in tree.explode_ancestors(leaves).select("node_path", "leaf_path").collect():
        whole.setdefault(r.node_path, []).append(r.leaf_path)
    found = {}
    for r in chunks.orderBy("node_path", "chunk").collect():
        assert r.n_chunks == -(-len(whole[r.node_path]) // size)
        assert len(r.params) == size or r.chunk == r.n_chunks - 1
        found.setdefault(r.node_path, []).extend(p.item for p in r.params)
    assert found == {node: sorted(items) for node, items in whole.items()}


def test_root_equals_flat_aggregate(spark):
    leaves = leaves_of(spark, [(f"p/d{i % 7}/f{i % 31}.c", f"f:{i}", i % 11, i % 5, i, i * i % 97) for i in range(800)])
    root = tree.rollup_stats(leaves).where("node_path = 'p'").first()
    flat = leaves.agg(F.avg("lif"), F.median("lif"), F.stddev_pop("lif"), F.median("sif")).first()
    assert (root.lif_mean, root.lif_median, root.sif_median) == (flat[0], flat[1], flat[3])
    assert root.lif_deviation == pytest.approx(flat[2])


def test_one_part_path_has_no_ancestors(spark):
    df = spark.createDataFrame([("lonely",), ("/a/b",)], "leaf_path string")
    assert rows(tree.explode_ancestors(df), "leaf_path", "node_path", "node_type") == [("/a/b", "a", "file")]


def test_component_counts(spark):
    nodes = spark.createDataFrame([("package",), ("item",), ("item",)], "node_type string")
    found = tree.component_counts(nodes).first()
    assert (found.package, found.file, found.item) == (1, 0, 2)
    assert found.status == '{"error":0,"statistic":{"package":1,"file":0,"item":2}}'


def test_flame_frames(spark):
    folded = spark.createDataFrame([("a;b;c", 3), ("a;b", 1), ("a;bb", 2), ("z", 4)], "stack string, value long")
    frames = {r.frame: (r.total, r.self, r.x, r.width, r.y) for r in view.flame_frames(folded, 100, 10).collect()}
    assert frames == {
        "a": (6, 0, 0.0, 60.0, 0.0),
        "a;b": (4, 1, 0.0, 40.0, 10.0),
        "a;b;c": (3, 3, 10.0, 30.0, 20.0),
        "a;bb": (2, 2, 40.0, 20.0, 10.0),
        "z": (4, 4, 60.0, 40.0, 0.0),
    }
    wide = view.flame_frames(folded, 100, 10, min_width=35)
    assert rows(wide, "frame") == [("a",), ("a;b",), ("z",)]


def test_frames_nest(spark):
    leaves = leaves_of(spark, [(f"p/d{i % 7}!/f {i % 31}.c", f"f:{i}", 1 + i % 11, 1, 1, 1) for i in range(300)])
    frames = {r.frame: r for r in view.flame_frames(view.fold_stacks(leaves, "mmcc")).collect()}
    for name, frame in frames.items():
        parent = frames.get(name.rpartition(";")[0])
        if parent is not None:
            assert frame.x >= parent.x - 1e-6 and frame.x + frame.width <= parent.x + parent.width + 1e-6


def test_attrs_are_checked(spark):
    with pytest.raises(ValueError):
        view.attr_list("mmcc,nonsense")


def test_parent_of(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",)], "p string")
    assert rows(df, parent_of("p")) == [("",), ("a/b",)]
