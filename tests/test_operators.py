"""Facts that the operators must keep, on small fixtures and against brute force."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from depotscan import storage
from depotscan.functions import scalar as S
from depotscan.functions.versions import version_key
from depotscan.operators import audit, closure, extract, graph, ingest, load, quality, retention, sets
from depotscan.sources import readers, schemas
from depotscan.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_version_order(spark):
    ordered = [["1.0~rc1"], ["1.0", "1.00", "1_0"], ["1.0^git1"], ["1.0a"], ["1.0.1"], ["2.a"], ["2.1"], ["9"], ["10"]]
    df = spark.createDataFrame([(v, i) for i, vs in enumerate(ordered) for v in vs], "v string, i int").withColumn("k", version_key(F.col("v")))
    pairs = df.alias("a").join(df.alias("b"), F.lit(True)).select(((F.col("a.i") < F.col("b.i")) == (F.col("a.k") < F.col("b.k"))).alias("ok"))
    assert pairs.where("not ok").count() == 0


def test_version_order_random(spark):
    def parts(v):
        found, i = [], 0
        while i < len(v):
            for kind, test in (("d", str.isdigit), ("a", str.isalpha)):
                j = i
                while j < len(v) and test(v[j]):
                    j += 1
                if j > i:
                    found.append((4, int(v[i:j])) if kind == "d" else (3, v[i:j]))
                    i = j
                    break
            else:
                if v[i] in "~^":
                    found.append((0 if v[i] == "~" else 2, 0))
                i += 1
        return [*found, (1, 0)]

    def less(a, b):
        for x, y in zip(parts(a), parts(b), strict=False):
            if x[0] != y[0]:
                return x[0] < y[0]
            if x[1] != y[1]:
                return x[1] < y[1]
        return False

    dice = random.Random(3)
    vs = ["".join(dice.choice("01a.~^9") for _ in range(dice.randint(0, 6))) for _ in range(60)]
    got = spark.createDataFrame(list(itertools.product(vs, vs)), "a string, b string").select("a", "b", (version_key(F.col("a")) < version_key(F.col("b"))).alias("less")).collect()
    assert all(r["less"] == less(r["a"], r["b"]) for r in got)


def test_scalar_edges(spark):
    r = one(
        spark, mode=S.file_mode_full(F.lit(0o104755)), sticky=S.file_mode(F.lit(0o1000)), none=S.file_mode(F.lit(None).cast("int")), flags=S.file_flags(F.lit(1 + 2 + 64)), blank=S.quote(F.lit("a b")), special=S.quote(F.lit("a\t'é")),
        u=S.parse_u64(F.lit(" \n")).cast("string"), bad=S.parse_u64(F.lit("1 2")), odd=S.hex_decode(F.lit("abc")), lit=S.array_literal(F.array(F.lit('x"y'))), nodir=S.same_directory(F.lit("a"), F.lit("b")), common=S.common_prefix_length(F.lit("/usr/a"), F.lit("/usr/b")), empty=S.common_prefix_length(F.lit(""), F.lit("b")),
    )
    assert (r.mode, r.sticky, r.none, r.flags, r.blank, r.special) == ("-rwsr-xr-x", "--------T", None, "dcg", "a b", "a\\t\\'\\xc3\\xa9")
    assert (r.u, r.bad, r.odd, r.lit, r.nodir, r.common, r.empty) == ("0", None, None, '{"x\\"y"}', False, 5, 0)
    assert str(one(spark, t=S.epoch_to_timestamp(F.lit(1347551182))).t) == "2012-09-13 15:46:22"


def test_ingest_twice_is_once(spark):
    new = spark.createDataFrame([("a",), ("b",), ("a",)], "digest string")
    first = ingest.intern_contents(new, spark.createDataFrame([], "digest string"))
    second = ingest.intern_contents(new, first.table.select("digest"))
    assert rows(first.table) == rows(second.table) and second.mapping.where("added").count() == 0


def test_set_diff_reports_a_change_once(spark):
    old, new = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(2,), (3,)], "p int")
    diff, changed = sets.set_diff(old, new, ["p"])
    assert rows(diff) == [(1, "removed"), (2, "unchanged"), (3, "added")] and changed.first()["changed"]
    assert not sets.set_diff(new, new, ["p"])[1].first()["changed"]


def test_set_apply_actions(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "set_id long, package_id long")
    wanted = spark.createDataFrame([(2,), (3,)], "package_id long")
    expected = {"update": [(1, 2), (1, 3), (2, 1)], "add": [(1, 1), (1, 2), (1, 3), (2, 1)], "delete": [(1, 1), (2, 1)], "empty": [(2, 1)]}
    assert all(rows(sets.set_apply(members, 1, wanted, a)) == want for a, want in expected.items())


def test_set_from_repos_stops_on_errors(spark):
    listing = spark.createDataFrame([("a", "x", None, "1", "1", 0, True), ("b", "x", None, "1", "1", 1, False)], "name string, arch string, epoch int, version string, release string, ordinal int, fetched boolean")
    assert sets.set_from_repos(listing, []).members.count() == 0
    done = sets.set_from_repos(listing, [], ignore_errors=True)
    assert done.members.count() == 1 and done.failed.count() == 1


def test_closure_of_dense_edges_and_none(spark):
    dice = random.Random(5)
    edges = {(dice.randrange(25), dice.randrange(25)) for _ in range(45)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    got = closure.transitive_closure(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert set(rows(got)) == want
    assert closure.transitive_closure(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_resolve_prefers_library_directories_then_the_smaller_package(spark):
    providers = spark.createDataFrame([("x", "l", 1, "/opt/l", "a"), ("x", "l", 2, "/lib64/l", "b"), ("x", "l", 3, "/lib64/l", "a")], "arch string, soname string, file_id long, path string, package string")
    needed = spark.createDataFrame([(9, "/opt/app", "x", "l"), (9, "/opt/app", "x", "none"), (8, "/a", "other", "l")], "file long, path string, arch string, needed_name string")
    assert rows(closure.resolve_needed(needed, providers).where("rank = 1").select("file", "provider")) == [(9, 3)]
    assert rows(closure.missing_needed(needed, providers)) == [(9, "x", "none")]


def test_pom_urls(spark):
    pom = "<project><url>h</url><scm><url> s </url><connection>c</connection></scm><distributionManagement><repository><url>d</url></repository><site><url>t</url></site></distributionManagement><a><site><b><url>o</url></b></site></a></project>"
    docs = spark.createDataFrame([(1, pom), (2, pom + "<"), (3, "<other><url>x</url></other>"), (4, None), (5, "<!DOCTYPE a [<!ENTITY b 'c'>]><project/>")], "doc_id long, xml string")
    assert rows(extract.pom_urls(docs).select("doc_id", "url", "type")) == [(1, "c", "connection"), (1, "d", "distributionManagement"), (1, "h", "other"), (1, "o", "other"), (1, "s", "scm"), (1, "t", "site")]
    assert [r[0] for r in rows(extract.xml_errors(docs)[1].select("doc_id"))] == [2, 5]


def test_python_symbols_in_source_order(spark):
    text = "from . import b\nimport a.c, d as e\nfrom ..m import *\nx.y.z = w.y\nasync def h(): pass\ndef f():\n  class K: pass\n"
    got = extract.python_symbols(spark.createDataFrame([(1, text), (1, text), (2, "\n="), (3, "")], "contents_id long, contents string"))
    names = [r["name"] for k in ("import", "attribute", "function", "class") for r in got.where(F.col("kind") == k).orderBy("pos").collect()]
    assert names == [".b", "a.c", "d", "..m.*", "y", "z", "f", "K"]


def test_permission_audit(spark):
    ddl = "path string, user_name string, group_name string, permissions string"
    expected, actual = spark.createDataFrame([("a", "u", "g", "p"), ("b", None, "g", "p"), ("c", "u", "g", "p")], ddl), spark.createDataFrame([("a", "u", "g", "p"), ("b", "x", "g", "p"), ("d", "u", "g", "p")], ddl)
    assert rows(audit.permission_audit(expected, actual).select("path", "status")) == [("b", "different"), ("c", "missing"), ("d", "unexpected")]


def test_expiry_counts_from_midnight(spark):
    cache = spark.sql("SELECT * FROM VALUES ('old', timestamp'2024-01-01 23:59:59'), ('new', timestamp'2024-01-02 00:00:00') AS t(url, last_access)")
    kept, expired = retention.expire_urls(cache, F.to_timestamp(F.lit("2024-01-05 18:00:00")))
    assert rows(kept.select("url")) == [("new",)] and rows(expired.select("url")) == [("old",)]


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert rows(quality.check_unique(df, ["k"])) == [(1, 2)]


def test_all_tables_can_be_made(spark, tmp_path):
    schemas.create_tables(spark, str(tmp_path))
    assert len(schemas.schemas()) == 37 and all(spark.read.parquet(f"{tmp_path}/{n}").count() == 0 for n in schemas.schemas())


def test_repository_files(spark, tmp_path):
    (tmp_path / "primary.xml").write_text('<metadata xmlns:rpm="r"><package type="rpm"><name>n</name><arch>x</arch><version epoch="32" ver="1.0" rel="2"/><checksum type="sha256">ab</checksum><size package="12"/><location xml:base="http://b" href="n.rpm"/><format><rpm:sourcerpm>n-1.0-2.src.rpm</rpm:sourcerpm></format></package></metadata>')
    (tmp_path / "repomd.xml").write_text('<repomd><revision>7</revision><data type="primary"><checksum type="sha256">a</checksum><open-checksum type="sha256">b</open-checksum><location href="r/p.xml.gz"/><size>5</size><open-size>9</open-size></data></repomd>')
    r = readers.repo_primary_scan(spark, str(tmp_path / "primary.xml"), "http://repo").first()
    assert (r.name, r.epoch, r.version, r.size, r.url, r.source) == ("n", "32", "1.0", 12, "http://b/n.rpm", "n-1.0-2.src.rpm")
    meta, entries = readers.repo_index_scan(spark, str(tmp_path / "repomd.xml"))
    assert rows(meta) == [("7",)] and entries.select("open_size", "compressed", "error").first() == (9, True, False)
    assert readers.repo_primary_pick(entries.withColumn("ordinal", F.lit(0)), "http://repo").first()["url"] == "http://repo/r/p.xml.gz"
    (tmp_path / "w.tsv").write_text("-rwsr-xr-x\troot\troot\t/bin/su\n")
    assert readers.whitelist_scan(spark, str(tmp_path / "w.tsv")).first().path == "/bin/su"
    assert readers.binary_scan(spark, str(tmp_path / "w.tsv")).first().length == 29


def test_line_ends_in_paths_and_texts(spark):
    text = "abc \u2028"
    got = one(spark, a=S.strip(F.lit(text)), b=S.strip(F.lit(" \n x \r\n")), c=S.same_directory(F.lit("/a\nb/x"), F.lit("/c\nd/y")), d=S.same_directory(F.lit("/a\nb/x"), F.lit("/a\nb/y")), e=S.parse_u64(F.lit("12\u2028")), f=S.base_name(F.lit("a/b\n")))
    assert tuple(got) == (text, "x", False, True, None, "b\n")
    kept, n = sets.exclude_names(spark.createDataFrame([("ab",), ("ab\n",)], "name string"), ["a."])
    assert rows(kept) == [("ab\n",)] and rows(n) == [(1,)]


def test_common_prefix_length(spark):
    dice = random.Random(4)
    pairs = [(x[: dice.randrange(len(x) + 1)], x[: dice.randrange(len(x) + 1)] + dice.choice(["", "z"])) for x in ("/usr/lib64/" + "ab" * 40 for _ in range(40))] + [("", ""), ("a", ""), ("é漢x", "é漢y"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.common_prefix_length(F.col("a"), F.col("b")).alias("n")).collect()
    length = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert all(r.n == (None if r.a is None else length(r.a, r.b)) for r in got)


def test_xml_is_told_by_the_first_byte_that_decides(spark):
    mark = b"\xef\xbb\xbf"
    cases = {b" " * 5000 + b"<project/>": "xml", mark + b"<a/>": "xml", b"\n " + mark + b"\t<a/>": "xml", mark * 3 + b" " * 300 + mark + b"<a/>": "xml", b" " * 255 + mark + b"<a/>": "xml", b" " * 5000 + b"x<a/>": None, mark[:2] + b"<a/>": None, b"\x0b<a/>": None, b"": None, b" " * 300: None}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in cases.items()], "data binary, want string")
    assert df.where(~extract.contents_kind(F.col("data"), F.lit(False)).eqNullSafe(F.col("want"))).count() == 0


def test_listing_root_is_checked(spark, tmp_path):
    package = "<package type='rpm'><name>a</name></package>"
    for name, text in (("good", f"<?xml version='1.0'?>\n<!-- <other> -->\n<metadata xmlns='x'>{package}</metadata>"), ("bad", f"<other>{package}</other>")):
        (tmp_path / f"{name}.xml").write_text(text)
    assert readers.repo_primary_scan(spark, f"{tmp_path}/good.xml").count() == 1
    with pytest.raises(Exception, match="not a repository listing: .*bad.xml"):  # raised where the file is read
        readers.repo_primary_scan(spark, f"{tmp_path}/bad.xml").count()


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_brute_force(spark, seed):
    dice = random.Random(seed)
    edges = {(dice.randrange(25), dice.randrange(25)) for _ in range(15 + 10 * seed)} | {(i, i + 1) for i in range(100, 113)} | {(200, 200)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert set(map(tuple, closure.transitive_closure(spark.createDataFrame(sorted(edges), "src long, dst long")).collect())) == want


def test_resolving_one_or_all_ranks_agrees(spark):
    dice = random.Random(8)
    providers = spark.createDataFrame([("x", f"s{dice.randrange(6)}", i, dice.choice(["/usr/lib64/", "/opt/a/", "/usr/lib/q/"]) + str(i), f"p{dice.randrange(3)}") for i in range(14)], "arch string, soname string, file_id long, path string, package string")
    needed = spark.createDataFrame([(i, dice.choice(["/opt/a/b", "/usr/bin/c"]), dice.choice(["x", None]), f"s{k}") for i in range(12) for k in range(7)], "file long, path string, arch string, needed_name string")
    every = closure.resolve_needed(needed, providers)
    assert rows(every.where("rank = 1")) == rows(closure.resolve_needed(needed, providers, best_only=True)) and every.where("rank > 1").count() > 0


def test_identifiers_that_digests_share_are_found(spark):
    table = ingest.intern_contents(spark.createDataFrame([(f"d{i % 50}",) for i in range(120)], "digest string"), spark.createDataFrame([("d1",)], "digest string")).table
    assert table.count() == 50 and ingest.surrogate_clashes(table).count() == 0
    weak = table.withColumn("contents_id", F.col("contents_id") % 7)
    assert 0 < ingest.surrogate_clashes(weak).count() <= 13


def test_newest_versions_over_micro_batches(spark, tmp_path):
    batches = [[("a", "x", None, "1.0", "1", 1), ("b", "x", 1, "1", "1", 2)], [("a", "x", None, "1.10", "1", 3), ("a", "y", None, "9", "1", 4)], [("a", "x", None, "1.9", "1", 5), ("b", "x", None, "7", "1", 6), ("c", "x", None, "1", "1", 7)]]
    ddl = "name string, arch string, epoch int, version string, release string, ordinal long"
    for batch in batches:  # one run of the job for each
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.stream_latest(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], ddl)
    assert rows(jobs.latest_state(spark, f"{tmp_path}/out").select("name", "arch", "ordinal")) == rows(sets.latest_per_name_arch(every).select("name", "arch", "ordinal")) == [("a", "x", 3), ("a", "y", 4), ("b", "x", 2), ("c", "x", 7)]


# Graphs


def closed(edges):
    """The closure, node by node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = set()
    for a in after:
        todo, seen = list(after[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend(after.get(b, ()))
        found |= {(a, b) for b in seen}
    return found


def strong(edges):
    pairs = closed(edges)
    found = {}
    for a in {a for a, b in pairs if a != b and (b, a) in pairs}:
        found[a] = min(b for b in {x for e in edges for x in e} if b == a or ((a, b) in pairs and (b, a) in pairs))
    return found


def graph_of(kind, dice):
    if kind == "ring":
        return {(i, (i + 1) % 40) for i in range(40)} | {(100, 101), (101, 102)}
    if kind == "rings":  # linked rings, each through a chain, some only one way
        return {(10 * k + i, 10 * k + (i + 1) % 10) for k in range(6) for i in range(10)} | {(10 * k, 10 * k + 15) for k in range(5)} | {(35, 20), (900, 0), (900, 900), (55, 901), (901, 902)}
    if kind == "chains":  # a chain that comes back to where it began, twice, and one that doesn't
        return {(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (4, 5), (5, 6), (6, 7), (8, 0), (8, 9), (9, 8)}
    if kind == "dag":
        return {(a, b) for a in range(30) for b in range(a + 1, 30) if dice.random() < 0.1}
    if kind == "self":
        return {(1, 1), (1, 2), (2, 2), (3, 3)}
    n = {"sparse": 60, "medium": 40, "dense": 15}[kind]
    return {(dice.randrange(n), dice.randrange(n)) for _ in range(65)}


@pytest.mark.parametrize("kind", ["ring", "rings", "chains", "dag", "self", "sparse", "medium", "dense"])
def test_components_and_closure_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK", 3)
    edges = graph_of(kind, random.Random(kind))
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.node: r.component for r in graph.strong_components(df).collect()} == strong(edges)
    got = [tuple(r) for r in graph.transitive_closure(df.unionByName(df)).collect()]
    assert set(got) == closed(edges) and len(got) == len(set(got))


def test_closure_of_names_and_nulls(spark):
    edges = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")}
    df = spark.createDataFrame([*edges, (None, "a"), ("d", None)], "x string, y string")
    assert set(map(tuple, graph.transitive_closure(df, "x", "y").collect())) == closed(edges)


def test_closure_of_a_large_component_makes_its_pairs_and_no_more(spark):
    """A ring with chords: no join makes more rows than the result has."""
    dice, n = random.Random(2), 700
    edges = {(i, (i + 1) % n) for i in range(n)} | {(dice.randrange(n), dice.randrange(n)) for _ in range(n)}
    found = graph.transitive_closure(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert found.count() == n * n and found.distinct().count() == n * n


@pytest.mark.parametrize("kind", ["rings", "dag", "sparse", "medium", "chains"])
def test_reach_against_brute_force(spark, monkeypatch, kind):
    dice = random.Random(3)
    edges = graph_of(kind, dice)
    nodes = sorted({x for e in edges for x in e})
    sources, targets = set(dice.sample(nodes, 4)), set(dice.sample(nodes, 5)) | {12345}
    monkeypatch.setattr(graph, "STEPS", 2)
    node = lambda some: spark.createDataFrame([(x,) for x in some], "node long")
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    pairs = closed(edges)
    assert set(map(tuple, graph.reach_pairs(df, node(sources), node(targets)).collect())) == {(a, b) for a, b in pairs if a in sources and b in targets}
    assert {r.node for r in graph.reachable(df, node(sources)).collect()} == {b for a, b in pairs if a in sources}
    assert {r.node for r in graph.reachable(df, node(targets), backward=True).collect()} == {a for a, b in pairs if b in targets}
    assert graph.reach_pairs(df, node(sources), node([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_a_maintained_closure_is_that_of_the_new_edges(spark, seed):
    dice = random.Random(seed)
    old = graph_of(["rings", "dag", "sparse", "medium", "ring", "chains"][seed], dice)
    nodes = sorted({x for e in old for x in e})
    gone = set(dice.sample(sorted(old), min(5, len(old)))) if seed != 2 else set()
    new = {(dice.choice(nodes), dice.choice([*nodes, 7777])) for _ in range(5 if seed != 3 else 0)} | ({(7777, 7778)} if seed % 2 else set())
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "src long, dst long")
    before, after = closed(old), closed((old - gone) | new)
    done = graph.maintain_closure(frame(before), frame(old), frame(gone | {(-1, -2)}), frame(new))
    table = [tuple(r) for r in done.table.collect()]
    assert set(table) == after and len(table) == len(after)
    assert set(map(tuple, done.deleted.collect())) == before - after and set(map(tuple, done.inserted.collect())) == after - before


def test_a_maintained_closure_leaves_other_pairs_alone(spark):
    """Two parts without a link: a change of the small one reads nothing of the large one's pairs but to carry them over."""
    large, small = {(i, i + 1) for i in range(1000, 1060)}, {(1, 2), (2, 3)}
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "src long, dst long")
    seen = {}
    store = graph.storage.store

    def counted(df, tag):
        kept = store(df, tag)
        seen[tag] = seen.get(tag, 0) + kept.count()
        return kept

    graph.storage.store, before = counted, store
    try:
        done = graph.maintain_closure(frame(closed(large | small)), frame(large | small), frame({(2, 3)}), frame({(3, 4)}))
        assert set(map(tuple, done.table.collect())) == closed(large | {(1, 2), (3, 4)})
    finally:
        graph.storage.store = before
    assert seen["closure-doubtful"] == 2 and seen.get("closure-again", 0) == 0 and seen["closure-added"] == 1


def test_closure_update_follows_a_new_provider(spark):
    ddl = "arch string, soname string, file_id long, path string, package string"
    old = [("x", "l", 1, "/opt/l", "a"), ("x", "m", 5, "/lib/m", "a")]
    needed = spark.createDataFrame([(9, "/opt/app", "x", "l"), (1, "/opt/l", "x", "m"), (3, "/lib/l", "x", "m")], "file long, path string, arch string, needed_name string")
    edges, first = closure.closure_update(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "src long, dst long"), needed, spark.createDataFrame(old, ddl))
    assert rows(first.table) == [(1, 5), (3, 5), (9, 1), (9, 5)]
    after, second = closure.closure_update(first.table, edges, needed, spark.createDataFrame([*old, ("x", "l", 3, "/lib/l", "b")], ddl))
    assert rows(after) == [(1, 5), (3, 5), (9, 3)] and rows(second.deleted) == [(9, 1)] and rows(second.inserted) == [(9, 3)] and rows(second.table) == [(1, 5), (3, 5), (9, 3), (9, 5)]


# Identifiers


def weak(digest):
    return F.pmod(F.xxhash64(digest), F.lit(256))


def test_identifiers_of_eight_bits_stay_apart(spark):
    known = spark.createDataFrame([], "digest string")
    every = {}
    for start in (0, 60, 110):
        new = spark.createDataFrame([(f"d{i}",) for i in range(start, start + 90)] + [(f"d{start}",), (None,)], "digest string")
        done = ingest.intern_contents(new, known, number=weak)
        known = storage.store(done.table, "interned")
        every |= {f"d{i}": None for i in range(start, start + 90)}
        got = {r.digest: r.contents_id for r in known.collect()}
        assert got.keys() == every.keys() and len(set(got.values())) == len(got)
        assert all(every[d] is None or every[d] == i for d, i in got.items())  # identifiers once given stay
        every = got
        looked = {r.digest: r.contents_id for r in ingest.ids_of(new, done.marked, number=weak).collect()}
        assert looked == {d: got.get(d) for d in looked} and looked[None] is None
        assert {r.digest: r.contents_id for r in done.mapping.where("digest is not null").collect()} == {d: got[d] for d in looked if d}
    assert ingest.surrogate_clashes(known).count() == 0 and 0 < known.where(F.col("contents_id") != weak("digest")).count() < 150


def test_attributes_of_eight_bits_stay_apart(spark):
    files = spark.range(400).select(F.col("id").alias("file_id"), (F.col("id") % 120).cast("int").alias("mode"), F.when(F.col("id") % 2 == 0, "x").alias("user_name"))
    dimension, keyed = ingest.intern_attributes(files, ["mode", "user_name"], weak)
    assert dimension.count() == dimension.select("attribute_id").distinct().count() == 120
    back = keyed.drop("mode", "user_name").join(dimension, "attribute_id").select("file_id", "mode", "user_name")
    assert rows(back) == rows(files)


# Streams


def test_latest_state_is_compacted_and_goes_on_after_a_restart(spark, tmp_path):
    ddl, dice = "name string, arch string, epoch int, version string, release string, ordinal long", random.Random(6)
    every = []
    for n in range(7):  # one run of the job, and so one restart, for each
        batch = [(f"n{dice.randrange(5)}", "x", None, str(dice.randrange(50)), "1", 10 * n + i) for i in range(6)]
        every += batch
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.stream_latest(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", every=2).awaitTermination()
        want = sets.latest_per_name_arch(spark.createDataFrame(every, ddl))
        assert rows(jobs.latest_state(spark, f"{tmp_path}/out")) == rows(want)
    snapshots, batches = storage.parts(spark, f"{tmp_path}/out", "snapshot"), storage.parts(spark, f"{tmp_path}/out", "batch")
    assert len(snapshots) == 2 and len(batches) <= 4 and min(batches) > snapshots[0]
    assert spark.read.parquet(f"{tmp_path}/out/snapshot={snapshots[-1]}").count() <= 5
    assert any("RocksDB" in str(p.read_bytes()) for p in tmp_path.joinpath("checkpoint").rglob("offsets/*") if p.is_file())
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass") or "")


def test_exact_interning_stream_forgets_nothing(spark, tmp_path):
    for n, values in enumerate((["a", "b"], ["b", "c"], ["a", "d"])):
        spark.createDataFrame([(v,) for v in values], "digest string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.stream_intern(spark.readStream.schema("digest string").parquet(f"{tmp_path}/in"))
        jobs.run_available(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        got = sorted(r.digest for r in spark.read.schema("digest string").parquet(f"{tmp_path}/out/epoch=*").collect())
        assert got == list("abcd")[: n + 2]


# URL cache


def test_url_cache_log_is_the_table_it_stands_for(spark, tmp_path):
    dice, cache = random.Random(12), retention.UrlCache(spark, f"{tmp_path}/cache")
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-{n:02d} 00:00:00"))
    table, stamp = {}, lambda n: f"2024-01-{n:02d} 00:00:00"
    for n in range(1, 10):
        if n % 3 == 1:
            new = [(f"u{dice.randrange(8)}", dice.randrange(9), bytearray(dice.randbytes(3))) for _ in range(5)]
            cache.put(spark.createDataFrame(new, "url string, http_time long, data binary"), day(n))
            for u in {u for u, _, _ in new}:
                _, t, d = max((x for x in new if x[0] == u), key=lambda x: (x[1], bytes(x[2])))
                table[u] = [t, bytes(d), stamp(n), stamp(n)]
        else:
            asked = [(f"u{i}", None if i % 2 else 3, None if i % 2 else dice.randrange(9)) for i in dice.sample(range(10), 5)]
            hits, misses = cache.lookup(spark.createDataFrame(asked, "url string, length long, http_time long"), day(n))
            good = {u for u, size, t in asked if u in table and (size is None or (size == len(table[u][1]) and t == table[u][0]))}
            assert {r.url for r in hits.collect()} == good and {r.url for r in misses.collect()} == {u for u, _, _ in asked} - good
            written = storage.parts(spark, cache.path, "touches")[-1]
            assert {r.url for r in spark.read.parquet(f"{cache.path}/touches={written}").collect()} == good
            for u in good:
                table[u][3] = stamp(n)
        if n in (3, 5, 6):
            cache.compact()
        got = {r.url: [r.http_time, bytes(r.data), str(r.last_change), str(r.last_access)] for r in cache.read().collect()}
        assert got == table
    assert len(storage.parts(spark, cache.path, "base")) == 2 and retention.UrlCache(spark, f"{tmp_path}/none").read().count() == 0


# Listings, XML, loads, facts


def test_listings_are_read_in_byte_ranges(spark, tmp_path):
    one_of = lambda i: f'<package type="rpm"><name>n{i}</name><arch>x</arch><version epoch="0" ver="1.0" rel="{i}"/></package>\n'
    lead = "<?xml version='1.0'?>\n<!-- <package> </x> -->\n<metadata a='>' packages=\"2000\">\n"
    (tmp_path / "p.xml").write_text(lead + "".join(map(one_of, range(2000))) + "<!-- end --></metadata>\n<!-- more -->")
    (tmp_path / "none.xml").write_text("<metadata packages='0'/>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = readers.repo_primary_scan(spark, [f"{tmp_path}/p.xml", f"{tmp_path}/none.xml"])
        assert found.rdd.getNumPartitions() > 5 and sorted(int(r.release) for r in found.collect()) == list(range(2000))
        assert "Scan text" in found._jdf.queryExecution().toString() and "wholetext" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for n, text in enumerate((f"<other>{one_of(1)}</other>", "<other/>", f"<metadata>{one_of(1)}</metadata><b/>", f"<metadata>{one_of(1)}<b/>{one_of(2)}</metadata>")):
        (tmp_path / f"bad{n}.xml").write_text(text)
        with pytest.raises(Exception, match=f"not a repository listing: .*bad{n}.xml"):
            readers.repo_primary_scan(spark, f"{tmp_path}/bad{n}.xml").collect()


def test_xml_is_parsed_once_for_urls_and_errors(spark):
    docs = {
        1: "<project><url>a<!-- c -->b<x>no</x>no</url><connection/><url> <![CDATA[ c&d ]]> </url><a><repository><b><scm><url>r</url></scm></b></repository></a></project>",
        2: "<project xmlns='x'><site><url>s</url><a><url>o</url></a></site><url><url>inner</url></url><downloadUrl>d<url>no</url></downloadUrl></project>",
        3: "<site><url>x</url></site>", 4: "<project>\n<url>a</url>\n<b></project>", 5: "<scm><project><url>x</url></project></scm>", 6: "<project><project><url>p</url></project></project>",
    }
    df = spark.createDataFrame([*docs.items(), (7, None), (8, "")], "doc_id long, xml string")
    got = [(r.doc_id, r.pos, r.url, r.type) for r in extract.pom_urls(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "ab", "other"), (1, 1, "c&d", "other"), (1, 2, "r", "repository"), (2, 0, "s", "site"), (2, 1, "o", "other"), (2, 2, "d", "downloadUrl"), (6, 0, "p", "other")]
    valid, errors = extract.xml_errors(df)
    assert [r[0] for r in rows(valid)] == [1, 2, 3, 5, 6] and [(r[0], r[2]) for r in rows(errors)] == [(4, 3), (8, 1)]
    bad = errors.where("doc_id = 4").first()
    assert (bytes(bad.before) + bytes(bad.after)).decode() in docs[4] and bytes(bad.before).endswith(b"<b></")
    assert extract.pom_urls(df)._jdf.queryExecution().toString().count("MapInArrow") == extract.xml_facts(df)._jdf.queryExecution().toString().count("MapInArrow")


def test_a_load_twice_adds_nothing_and_keeps_contents_once(spark):
    ddl = "package_id long, name string, mode int, nlinks int, target string, flags int, inode int, mtime long, user_name string, group_name string, caps string, data binary"
    same = lambda name, data, mode=0o100644, target=None, flags=0: (1, name, mode, 1, target, flags, 4, 0, "root", "root", "", data and bytearray(data))
    body = b"#!/usr/bin/python\nimport os\n" + b"#" * 60
    entries = spark.createDataFrame([same("/a.py", body), same("/etc/b", body), same("/c", body), same("/x.pom", b"<project><url>u</url></project>"), same("/bad.xml", b"<a>"), same("/ghost", b"left over", flags=64), same("/d", None, 0o040755), same("/l", None, 0o120777, "/a.py"), same("/no", None, 0o120777), same("/dev", None, 0o060644), same("/plain", b"z" * 100)], ddl)
    none = spark.createDataFrame([], "digest string, contents_id long")
    done = load.load_packages(entries, none)
    files = {r.name: r for r in done.files.collect()}
    contents = {r.contents_id: r for r in done.contents.collect()}
    assert len(files) == 7 and len(contents) == 5 and files["/a.py"].contents_id == files["/c"].contents_id
    assert len(contents[files["/c"].contents_id].preview) == len(body) and len(contents[files["/plain"].contents_id].preview) == 64  # a name below /etc/ keeps all
    assert files["/ghost"].length == 0 and contents[files["/ghost"].contents_id].preview == b"" and files["/ghost"].inode == 0
    assert {r.contents_id: r.kind for r in done.kinds.where("kind is not null").collect()} == {files["/c"].contents_id: "python", files["/x.pom"].contents_id: "xml", files["/bad.xml"].contents_id: "xml"}
    assert [getattr(r, "import") for r in done.python.collect()] == [["os"]]
    assert {(r.contents_id, r.message is None, len(r.urls)) for r in done.xml.collect()} == {(files["/x.pom"].contents_id, True, 1), (files["/bad.xml"].contents_id, False, 0)}
    assert rows(done.directories.select("name")) == [("/d",)] and rows(done.symlinks.select("name", "target")) == [("/l", "/a.py")] and rows(done.errors.select("name")) == [("/dev",), ("/no",)]
    assert done.attributes.count() == 2
    again = load.load_packages(entries, done.contents.select("digest", "contents_id"))
    assert again.contents.count() == again.python.count() == again.xml.count() == again.kinds.count() == 0
    assert rows(again.files.select("name", "contents_id")) == rows(done.files.select("name", "contents_id"))


def test_bucketed_facts_meet_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sink = lambda df, name: readers.bucketed_fact_sink(df, name, "contents_id", 4, f"{tmp_path}/{name}")
        files = sink(spark.range(100).select(F.col("id").alias("contents_id"), (F.col("id") % 9).alias("package_id")), "b_file")
        facts = sink(spark.range(400).select((F.col("id") % 200).alias("contents_id"), F.col("id").cast("string").alias("name")), "b_reference")
        cat = {"file_contents": sink(spark.range(150).select(F.col("id").alias("contents_id")), "b_contents"), "file": files, "elf_reference": facts}
        done = retention.expire_contents(cat)
        assert done["file_contents"].count() == 100 and done["elf_reference"].count() == 200
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(done["elf_reference"]) and "Exchange" not in plan(done["file_contents"])
        assert "Exchange" not in plan(facts.groupBy("contents_id").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("b_file", "b_reference", "b_contents"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_symbols_of_many_libraries_are_dealt_to_blocks(spark):
    n = 60
    ids = spark.range(n).select(F.col("id").alias("k"))
    cat = {
        "package_set": spark.createDataFrame([(1, "s")], "set_id long, name string"), "package_set_member": ids.select(F.lit(1).cast("long").alias("set_id"), F.col("k").alias("package_id")),
        "package": ids.select(F.col("k").alias("package_id"), F.concat(F.lit("p"), "k").alias("name"), F.lit(None).cast("int").alias("epoch"), F.lit("1").alias("version"), F.lit("1").alias("release"), F.lit("binary").alias("kind"), F.lit("x").alias("arch")),
        "file": ids.select(F.col("k").alias("file_id"), F.col("k").alias("package_id"), F.col("k").alias("contents_id"), F.concat(F.lit("/usr/lib64/l"), "k", F.lit(".so")).alias("name")),
        "elf_file": ids.select(F.col("k").alias("contents_id"), F.lit("x86_64").alias("arch"), F.concat(F.lit("l"), (F.col("k") % 50).cast("string")).alias("soname")),
        "elf_definition": ids.select(F.col("k").alias("contents_id"), F.lit("hot").alias("name")).unionByName(ids.where("k < 3").select(F.col("k").alias("contents_id"), F.lit("cold").alias("name"))),
    }
    found = audit.symbol_collisions(cat, "s", block=7)
    got = rows(found.select("name", "path_1", "path_2"))
    want = sorted([("hot", f"/usr/lib64/l{a}.so", f"/usr/lib64/l{b}.so") for a in range(n) for b in range(a + 1, n) if a % 50 != b % 50] + [("cold", f"/usr/lib64/l{a}.so", f"/usr/lib64/l{b}.so") for a in range(3) for b in range(a + 1, 3)])
    assert got == want and rows(audit.symbol_collisions(cat, "s")) == rows(found)


def test_epochs_of_listings(spark):
    cases = {"0": 0, " 7 ": 7, "": 0, " ": 0, None: None, "-1": "bad", "1x": "bad", "2147483648": "bad", "2147483647": 2147483647}
    df = spark.createDataFrame([("rpm", "n", "x", e, "1", "h", "c", 5) for e in cases], "type string, name string, arch string, epoch string, version string, href string, checksum string, size long")
    good, bad = readers.repo_primary_validate(df)
    assert sorted(map(str, (r.epoch for r in good.collect()))) == sorted(str(v) for v in cases.values() if v != "bad")
    assert {(r.epoch, r.reason) for r in bad.collect()} == {(k, "epoch") for k, v in cases.items() if v == "bad"}


def shuffled(spark, df):
    """(rows, bytes) that df's stages write to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    store, bridge = sc.statusStore(), spark.sparkContext._gateway.jvm.scala.jdk.javaapi.CollectionConverters

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in bridge.asJava(found)}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return tuple(map(sum, zip(*(n for k, n in stages().items() if k not in before))))


def test_choices_are_listed_once_for_a_path(spark):
    names = [f"/opt/{i}" for i in range(4)]
    providers = spark.createDataFrame([("x", "l", i, random.Random(i % 690).randbytes(30).hex(), "p") for i in range(700)] + [("x", "one", 1, "/lib/one", "p")], "arch string, soname string, file_id long, path string, package string")
    needed = spark.createDataFrame([(i, f"{names[i % 4]}/b", "x", n) for i in range(120) for n in ("l", "one", "none")], "file long, path string, arch string, needed_name string")
    found = closure.soname_conflicts(needed, providers)
    ranked = closure.resolve_needed(needed, providers).where("needed_name = 'l'").collect()
    want = {i: [f"{r.package}:{r.path}" for r in sorted((r for r in ranked if r.file == i), key=lambda r: r.rank)] for i in range(120)}
    got = found.collect()
    assert len(got) == 120 and {(r.file, r.needed_name): r.choices for r in got} == {(i, "l"): c for i, c in want.items()} and all(len(c) == 700 for c in want.values())
    assert rows(closure.soname_conflicts(needed, providers, ",")) == sorted((i, "l", ",".join(c)) for i, c in want.items())
    assert shuffled(spark, found)[1] < 2_000_000  # a list has 60 kB


def test_choices_without_architecture(spark):
    providers = spark.createDataFrame([("", "l", 1, "/b", "p"), ("", "l", 2, "/lib/b", "p"), ("", "l", 3, "/b", "p"), ("x", "l", 4, "/c", "p")], "arch string, soname string, file_id long, path string, package string")
    needed = spark.createDataFrame([(1, "/b", None, "l"), (2, "/lib/b", "x", "l"), (3, "/usr/q", "", "l")], "file long, path string, arch string, needed_name string")
    assert rows(closure.soname_conflicts(needed, providers, ",")) == [(1, "l", "p:/lib/b,p:/b,p:/b"), (3, "l", "p:/lib/b,p:/b,p:/b")]


def test_timestamps_of_distant_years_read_as_in_sql(spark):
    keys = [0, 1, 149_999, 2_932_896, 2_932_920, 2_932_930, 3_000_000, 7_654_321, 8_999_999, 50_000_000, 106_751_990, -1, -719_000, -719_527, -719_540, -719_900, -800_000, -5_000_000, None]
    seconds = [None if k is None else k * 86399.0 + f for k in keys for f in (0, 0.25)]
    text = S.timestamp_text(S.epoch_to_timestamp(F.col("s")))
    got = [r.r for r in spark.createDataFrame([(s,) for s in seconds], "s double").coalesce(1).select(text.alias("r")).collect()]
    want = [duckdb.execute("SELECT CAST(TIMESTAMP '1970-01-01' + to_seconds(?) AS VARCHAR)", [s]).fetchone()[0] for s in seconds]
    assert got == want
    assert {"0001-01-10 (BC) 07:52:07", "10183-08-17 06:40:00", "26610-11-16 20:00:00.999936", "2380-09-05 06:20:01", None} <= set(got)


def library_catalog(spark, libraries, defined):
    """A set of all packages; libraries has (package, contents, file, arch, soname), defined (contents, name)."""
    df = spark.createDataFrame(libraries, "package_id long, contents_id long, name string, arch string, soname string")
    packages = df.select("package_id").distinct()
    return {
        "package_set": spark.createDataFrame([(1, "s")], "set_id long, name string"), "package_set_member": packages.select(F.lit(1).cast("long").alias("set_id"), "package_id"),
        "package": packages.select("package_id", F.concat(F.lit("p"), "package_id").alias("name"), F.lit(None).cast("int").alias("epoch"), F.lit("1").alias("version"), F.lit("1").alias("release"), F.lit("binary").alias("kind"), F.lit("x").alias("arch")),
        "file": df.select("package_id", "contents_id", "name"), "elf_file": df.select("contents_id", "arch", "soname").distinct(), "elf_definition": spark.createDataFrame(defined, "contents_id long, name string"),
    }


@pytest.mark.parametrize("block,cells", [(3, 10), (3, 4096), (1000, 4096), (1, 1)])
def test_collisions_against_brute_force(spark, block, cells):
    dice = random.Random(11)
    contents = [(c, dice.choice("xy"), dice.choice(["a", "b", "c", None])) for c in range(30)]
    libraries = [(dice.randrange(12), c, f"/usr/lib/{i}.so", arch, soname) for i in range(60) for c, arch, soname in [dice.choice(contents)]]
    defined = [(dice.randrange(34), dice.choice(["hot", "hot", "warm", "cold", "_init"])) for _ in range(120)] + [(c, "rare") for c in (1, 2)]
    names = {c: {n for d, n in defined if d == c and n != "_init"} for c in range(30)}
    want = sorted((n, f"p{p}-1-1.x", f, f"p{q}-1-1.x", g) for p, c, f, a, s in libraries for q, d, g, b, t in libraries for n in names[c] & names[d] if c < d and p != q and a == b and s and t and s != t)
    assert want and rows(audit.symbol_collisions(library_catalog(spark, libraries, defined), "s", block=block, cells=cells)) == want


def test_copies_of_a_symbol_grow_with_its_libraries(spark):
    def copies(n):
        found = audit.symbol_collisions(library_catalog(spark, [(i, i, f"/usr/lib/{i}.so", "x", f"s{i}") for i in range(n)], [(i, "hot") for i in range(n)]), "s", block=2)
        assert found.count() == n * (n - 1) // 2
        return shuffled(spark, found)[0]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert copies(600) < 2.5 * copies(300)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
