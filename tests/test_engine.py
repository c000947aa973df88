"""Sources, patterns, index, graphs, pipeline, relevance, streaming."""

import itertools

import pytest
from pyspark.sql import functions as F

from tilery.functions.terms import TermModel
from tilery.operators import edges as E
from tilery.operators import lexicon as L
from tilery.operators import paths as P
from tilery.operators import relevance as R
from tilery.operators.expand import alias_matcher, alias_pattern, expand_pattern
from tilery.operators.items import live_items
from tilery.operators.numbering import number_rows
from tilery.plans import pipeline
from tilery.schemas import ITEM, UNKNOWN_ID
from tilery.sources import catalog

ITEMS = """
items:
  - {pid: 1, name: Red Sedan, aliases: ["red sedan", "exact:(crimson,scarlet) sedan"], registerName: x}
  - {pid: 2, name: Old, aliases: [old]}
  - {pid: 3, name: Moon Roof, aliases: ["moon [roof]"]}
  - {pid: 2, name: Tow Package, aliases: ["trailer hitch", "prefix:tow package"]}
"""


def test_items_from_yaml(spark):
    rows = sorted(catalog.items_from_yaml(spark, ITEMS, "cars").collect(), key=lambda r: r["ord"])
    assert [(r["pid"], r["name"], r["ord"]) for r in rows] == [(1, "Red Sedan", 0), (2, "Tow Package", 1), (3, "Moon Roof", 2)]


@pytest.mark.parametrize("text", ["items: 3", "[]", "items: [{pid: x, name: a, aliases: []}]", "items: [{pid: 1, aliases: []}]", "items: [{pid: 1, name: a, aliases: b}]"])
def test_bad_items(spark, text):
    with pytest.raises(TypeError):
        catalog.items_from_yaml(spark, text, "d")


def test_tests_from_yaml(spark):
    text = '- {priority: 1, suites: "general  bug", input: "no", expected: "[A]"}\n'
    row = catalog.tests_from_yaml(spark, text).first()
    assert (row["id"], row["priority"], row["suites"], row["input"]) == (0, "1", ["general", "bug"], "no")
    for bad in ("x: 1", "- {priority: 1.5, suites: a, input: b, expected: c}", "- {priority: 1, suites: a, input: b}"):
        with pytest.raises(TypeError):
            catalog.tests_from_yaml(spark, bad)
    again = catalog.tests_to_yaml([{"priority": 1, "suites": "a", "input": "b", "expected": "c"}])
    assert catalog.tests_from_yaml(spark, again).first()["input"] == "b"


def test_stop_words(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" the \n\nwith\n")
    words = catalog.stop_words(spark, str(tmp_path / "s.txt"))
    assert [r[0] for r in words.collect()] == ["the", "", "with"]
    assert {(r["name"], r["aliases"][0]) for r in catalog.stop_word_items(words).collect()} == {("the", "exact:the"), ("with", "exact:with")}


def test_items_from_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(ITEMS)
    (tmp_path / "b.yaml").write_text("items: [{pid: 9, name: n, aliases: []}]")
    items = catalog.items_from_files(spark, {"cars": str(tmp_path / "a.yaml"), "b": str(tmp_path / "b.yaml")})
    assert {(r["domain"], r["pid"]) for r in items.collect()} == {("cars", 1), ("cars", 2), ("cars", 3), ("b", 9)}


PATTERNS = {
    "a [b,c] d": ["a b d", "a c d", "a d"], "a (b,c) d": ["a b d", "a c d"], "plain": ["plain"], "a [,b] c": ["a c"],
    "[ very small , medium ] ( red, green )  marble [ rolling ]": [
        f"{s} {c} marble {r}".strip().replace("  ", " ") for s in ("very small", "medium", "") for c in ("red", "green") for r in ("rolling", "")],
}


def test_patterns(spark):
    frame = spark.createDataFrame([(k,) for k in PATTERNS], "p string").select("p", expand_pattern(F.col("p")).alias("x"))
    assert {r["p"]: r["x"] for r in frame.collect()} == PATTERNS
    with pytest.raises(Exception, match="trailing comma"):
        spark.createDataFrame([("a []d,e,] (b,c,) d",)], "p string").select(expand_pattern(F.col("p"))).collect()


def test_matcher_names(spark):
    rows = spark.createDataFrame([("exact: a",), ("b",), (" prefix :c:d",)], "e string").select(alias_matcher(F.col("e")), alias_pattern(F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [("exact", " a"), ("relaxed", "b"), ("prefix", "c:d")]
    with pytest.raises(Exception, match="unknown matcher"):
        spark.createDataFrame([("fuzzy:a",)], "e string").select(alias_matcher(F.col("e"))).collect()


def test_postings(spark):
    rows = [(0, "a b c".split()), (1, "b c d".split()), (2, "d e f".split()), (3, ["g", "g"])]
    aliases = spark.createDataFrame(rows, "alias_id long, stems array<string>").withColumn("hashes", F.col("stems"))
    got = {r["stem"]: (r["alias_ids"], r["frequency"]) for r in L.postings(aliases).collect()}
    assert got == {"a": ([0], 1), "b": ([0, 1], 2), "c": ([0, 1], 2), "d": ([1, 2], 2), "e": ([2], 1), "f": ([2], 1), "g": ([3, 3], 2)}


def test_downstream(spark):
    own = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3)], "domain string, hash long")
    numbers = spark.createDataFrame([(9,)], "hash long")
    got = {tuple(r) for r in L.downstream_terms(own, numbers).collect()}
    assert got == {("x", 2), ("x", 3), ("y", 1), ("y", 2), ("x", 9), ("y", 9)}


def test_number_rows(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert all(r["v"] == r["n"] for r in number_rows(frame, ["v"], "n").collect())
    assert number_rows(spark.createDataFrame([], "v int"), ["v"], "n").count() == 0


def test_live_items(spark):
    rows = [(1, 1, 1, "2024-01-01", "a"), (2, 1, 1, "2024-01-02", "b"), (3, 1, 1, "2024-01-02", "c"), (4, 1, 2, None, "d"), (5, None, 2, None, None), (6, None, 2, None, "f")]
    frame = spark.createDataFrame(rows, "item_key long, collection_id int, pid long, loaded_at string, name string")
    got = {(r["item_key"], r["name"]) for r in live_items(frame, keep=("name",)).collect()}
    assert got == {(3, "c"), (4, "d"), (6, "f")}


def _complete(n):
    return [[(k - 0.2**k, k, k) for k in range(1, n - i + 1)] for i in range(n)]


def test_complete_graph():
    assert len(list(P.all_paths(_complete(6)))) == 32
    assert [[e[1] for e in p] for p in P.maximal_paths(_complete(6))] == [[6]]
    tied = _complete(6)
    tied[0].append((6 - 0.2**6, 6, 99))
    assert len(list(P.maximal_paths(tied))) == 2


def test_tied_paths_in_order():
    graph = [[(1.0, 1, 0)], [(1.0, 1, 1), (1.0, 1, 2), (1.0, 2, 7)], [(1.0, 1, 3)], [(1.0, 1, 4), (1.0, 1, 5), (0.5, 1, 8)], [(1.0, 1, 6)]]
    assert [[e[2] for e in p] for p in P.maximal_paths(graph)] == [[0, 1, 3, 4, 6], [0, 2, 3, 4, 6], [0, 1, 3, 5, 6], [0, 2, 3, 5, 6]]


def test_odd_graphs():
    assert list(P.all_paths([])) == [] and list(P.maximal_paths([])) == []
    assert list(P.all_paths([[(1.0, 2, 1)]])) == []
    nothing = [[(float("nan"), 1, 1), (None, 1, 2), (0.0, 1, -1), (5.0, 0, 3)]]
    assert [[e[2] for e in p] for p in P.maximal_paths(nothing)] == [[-1]]


def test_paths_against_enumeration():
    import random

    random.seed(3)
    for _ in range(200):
        n = random.randint(1, 6)
        graph = [[(random.randint(0, 3) / 2, random.randint(1, 3), t) for t in range(random.randint(0, 3))] for _ in range(n)]

        def walk(at, graph=graph, n=n):
            if at == n:
                yield []
            elif at < n:
                for edge in {(e[1], e[2]): e for e in graph[at]}.values():
                    for rest in walk(at + edge[1]):
                        yield [edge, *rest]

        every = sorted(map(tuple, walk(0)))
        assert sorted(map(tuple, P.all_paths(graph))) == every
        top = max((sum(e[0] for e in p) for p in every), default=None)
        assert sorted(map(tuple, P.maximal_paths(graph))) == [p for p in every if sum(e[0] for e in p) == top]


def test_edge_filters(spark):
    rows = [(1, 0, 0, 0.0, 1, UNKNOWN_ID), (1, 0, 1, float("nan"), 0, 5), (1, 0, 2, None, 0, 5), (1, 0, 3, 2.0, 1, 5), (1, 0, 4, 2.0, 1, 5), (1, 0, 5, 3.0, 2, 5)]
    edges = spark.createDataFrame(rows, "query_id long, start int, ord long, score double, length int, token_id long")
    assert sorted(r["ord"] for r in E.filter_edges(edges, 2.5).collect()) == [0, 5]
    assert sorted(r["ord"] for r in E.coalesce_edges(E.filter_edges(edges, 0.5)).collect()) == [0, 3, 5]
    lists = E.edge_lists(edges, spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "query_id long, n int"))
    got = {r["query_id"]: [[e["token_id"] for e in place] for place in r["edge_lists"]] for r in lists.collect()}
    assert got == {1: [[5, 5, 5, UNKNOWN_ID], []], 2: [[]], 3: []}


def test_spans(spark):
    paths = spark.createDataFrame([(1, [[(1.0, 2, 7), (2.0, 1, 8)]])], "query_id long, p array<array<struct<score:double,length:int,token_id:long>>>")
    rows = P.path_rows(paths, F.col("p")).select("score", P.spans(F.col("path")).alias("s")).collect()
    assert rows[0]["score"] == 3.0 and [(s["token_id"], s["start"], s["length"]) for s in rows[0]["s"]] == [(7, 0, 2), (8, 2, 1)]


def test_graph_by_boundaries(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5, 1.0), (1, 0, 1, 5, 2.0), (1, 0, 1, 6, 1.0), (2, 3, 2, 5, 1.0)], "g int, from int, to int, token int, score double")
    assert {(r["to"], r["in_degree"]) for r in P.in_degrees(edges).collect()} == {(1, 2), (2, 1)}
    cycles = edges.unionByName(spark.createDataFrame([(3, 0, 1, 5, 1.0), (3, 1, 2, 5, 1.0), (3, 2, 0, 5, 1.0), (4, 1, 1, 5, 1.0)], edges.schema))
    assert {tuple(r) for r in P.is_dag(cycles, "g").collect()} == {(1, True), (2, True), (3, False), (4, False)}
    assert {tuple(r) for r in P.vertex_counts(cycles, "g").collect()} == {(1, 2), (2, 2), (3, 3), (4, 1)}
    assert {r["score"] for r in P.add_edges(edges).where("token = 5 and to = 1").collect()} == {2.0}


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("entities", 0, 20, "Red Sedan", ["red [two door] sedan", "crimson sedan"]), ("entities", 1, 30, "Moon Roof", ["moon roof"]),
            ("quantifiers", 0, 1, "one", ["exact:(a,the)"]), ("intents", 0, 1, "ADD_TO_ORDER", ["exact:I'd like", "exact:give me"]),
            ("intents", 1, 2, "CONJUNCTION", ["exact:(and,with)"]), ("stop", 0, 1, "stop", ["exact:sedan"])]
    items = spark.createDataFrame(rows, ITEM)
    return L.build_lexicon(items, ["entities", "quantifiers", "intents", "stop"], TermModel(), not_ingested=("stop",))


SAID = {
    "I'd like a red sedan with moon roof": "[ADD_TO_ORDER] [QUANTIFIER:1] [ENTITY:RED_SEDAN,20] [CONJUNCTION] [ENTITY:MOON_ROOF,30]",
    "give me twenty one red two door sedans": "[ADD_TO_ORDER] [NUMBER:21] [ENTITY:RED_SEDAN,20]",
    "shiny crimson sedan and the moon roof please": "[WORD:SHINY] [ENTITY:RED_SEDAN,20] [CONJUNCTION] [QUANTIFIER:1] [ENTITY:MOON_ROOF,30] [WORD:PLEASE]",
    "zebra": "[WORD:ZEBRA]",
}


def test_both_forms_agree(spark, lexicon):
    said = spark.createDataFrame([(i, t) for i, t in enumerate([*SAID, None, ""])], "id long, said string")
    tokens = pipeline.token_table(lexicon, {"entities": "ENTITY", "quantifiers": "QUANTIFIER", "intents": "INTENT"})
    want = dict(enumerate(SAID.values()))
    for form in (pipeline.tile_local, pipeline.tile_relational):
        got = {r["id"]: r["observed"] for r in pipeline.token_strings(form(said, "id", "said", lexicon), "id", tokens).collect()}
        assert {k: v for k, v in got.items() if k < len(SAID)} == want, form


def test_lexicon_parts(spark, lexicon):
    ids = sorted(r["alias_id"] for r in lexicon.aliases.select("alias_id").collect())
    assert ids == list(range(len(ids)))  # stop words come last and have no aliases
    assert {"sedan", "hundred", "I'd"} <= {r[0] for r in lexicon.vocabulary().collect()}
    report = L.index_report(lexicon.aliases).collect()
    assert report[0]["tokens"] >= report[-1]["tokens"]


def test_stem_groups(spark):
    words = spark.createDataFrame([("rim",), ("rims",), ("rim",), ("car",)], "w string")
    got = {r["stem"]: (r["terms"], r["n_terms"]) for r in L.stem_groups(words, "w", F.regexp_replace("w", "s$", "")).collect()}
    assert got == {"rim": (["rim", "rims"], 2), "car": (["car"], 1)}


def test_relevance(spark):
    tests = spark.createDataFrame([(1, "1", ["a", "b"], "x", "[A]  [B]"), (2, "2", ["a"], "y", "[C]"), (3, "2", [], "z", "[D]")], "id int, priority string, suites array<string>, input string, expected string")
    seen = spark.createDataFrame([(1, "[A] [B]"), (2, "[X]")], "id int, observed string")
    evaluated = R.evaluate(tests, seen, "id")
    assert {(r["priority"], r["n_passed"], r["n_run"]) for r in R.tally(evaluated, "priority").collect()} == {("1", 1, 1), ("2", 0, 2)}
    assert tuple(R.tally(evaluated).first()) == (1, 3)
    suites = tests.select("id", F.explode("suites").alias("suite"))
    assert {tuple(r) for r in R.by_suite(evaluated, suites, "id").collect()} == {("a", 1, 2), ("b", 1, 1)}
    assert {r["input"] for r in R.failing(evaluated).collect()} == {"y", "z"}
    assert {r["expected"] for r in R.rebase(evaluated).collect()} == {"[A] [B]", "[X]", None}
    paths = spark.createDataFrame([(1, "[A]  [B]"), (1, "[Q]"), (2, "[X]")], "id int, path_text string")
    assert {tuple(r) for r in R.passes_any(tests, paths, "id").collect()} == {(1, True), (2, False), (3, False)}


def test_stream(spark, lexicon, tmp_path):
    from tilery.streaming import tile_stream, write_stream

    spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "id long, said string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, said string").parquet(str(tmp_path / "in"))
    running = write_stream(tile_stream(stream, "id", "said", lexicon), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(SAID)


def test_iteration_of_ties_is_stable():
    graph = [[(1.0, 1, t) for t in range(3)] for _ in range(3)]
    assert [[e[2] for e in p] for p in P.all_paths(graph)] == [list(reversed(p)) for p in itertools.product(range(3), repeat=3)]


def test_some_path_reads():
    graph = [[(1.0, 1, 1), (2.0, 2, 2)], [(1.0, 1, 3)], [(1.0, 1, 4)]]
    reads = lambda *wanted: P.some_path_reads(graph, lambda e, start: f"{e[2]}@{start}", list(wanted))
    assert reads("1@0", "3@1", "4@2") and reads("2@0", "4@2")
    assert not reads("2@0") and not reads("1@0", "4@2") and not reads() and not reads("2@0", "4@2", "4@2")
    assert P.some_path_reads([], lambda e, s: "", [])


def test_lattice_matches():
    # red, then either sedan or one edge over two places that is also a sedan
    graph = [[(0.0, 1, 7)], [(0.0, 1, 8), (0.0, 2, 9)], [(0.0, 1, 10)]]
    assert P.lattice_matches(graph, 0, [7, 8]) == {2: 2.0, 3: 0.5}
    assert P.lattice_matches(graph, 0, [7, 9]) == {3: 2.0, 2: 0.5}
    assert P.lattice_matches(graph, 1, [99]) == {}


def test_lattices_in_frames(spark):
    graphs = [[[(0.0, 1, 7)], [(0.0, 1, 8), (0.0, 2, 9)], [(0.0, 1, 10)]], [], [[(0.0, 1, 7)]]]
    kind = "id long, g array<array<struct<score:double,length:int,token_id:long>>>, p array<long>"
    frame = spark.createDataFrame([(i, g, [7, 8]) for i, g in enumerate(graphs)], kind)
    got = {r["id"]: {m["end"]: m["score"] for m in r["m"]} for r in frame.select("id", P.lattice_matches_column("g", F.lit(0), F.col("p")).alias("m")).collect()}
    assert got == {i: P.lattice_matches(g, 0, [7, 8]) for i, g in enumerate(graphs)} and got[0] == {2: 2.0, 3: 0.5}


def _both(spark, lexicon, said, **options):
    frame = spark.createDataFrame(list(enumerate(said)), "id long, said string")
    kinds = {"entities": "ENTITY", "quantifiers": "QUANTIFIER", "intents": "INTENT"}
    for form in (pipeline.tile_local, pipeline.tile_relational):
        tiled = form(frame, "id", "said", lexicon, **options)
        yield {r["id"]: r["observed"] for r in pipeline.token_strings(tiled, "id", pipeline.token_table(lexicon, kinds)).collect()}


def test_numbers_are_read_by_their_stems(spark, lexicon):
    said = ["two hundreds red sedans", "Three Thousands", "twenty ones moon roof"]
    want = {0: "[NUMBER:200] [ENTITY:RED_SEDAN,20]", 1: "[NUMBER:3000]", 2: "[NUMBER:21] [ENTITY:MOON_ROOF,30]"}
    assert list(_both(spark, lexicon, said)) == [want, want]


def test_another_number_parser(spark, lexicon):
    dozen = TermModel().stem_and_hash("dozen")
    numbers = lambda hashes: [(12, 1)] if hashes[:1] == [dozen] else []
    want = {0: "[NUMBER:12] [ENTITY:MOON_ROOF,30]", 1: "[WORD:TWO] [ENTITY:MOON_ROOF,30]"}
    assert list(_both(spark, lexicon, ["dozen moon roof", "two moon roof"], numbers=numbers)) == [want, want]


def test_another_matcher(spark, monkeypatch):
    """A matcher of the caller's own, by name, with an equality of its own: any term stands for `thing`."""
    from tilery.functions.matchers import REGISTRY, exact_prefix

    thing = TermModel().stem_and_hash("thing")
    monkeypatch.setitem(REGISTRY, "loose", lambda q, p, downstream, token: exact_prefix(q, p, False, downstream, lambda a, b: b == thing or a == b))
    items = spark.createDataFrame([("entities", 0, 20, "Any Roof", ["loose:moon thing roof"]), ("intents", 0, 1, "GO", ["exact:go"])], ITEM)
    lexicon = L.build_lexicon(items, ["entities", "intents"], TermModel())
    want = {0: "[GO] [ENTITY:ANY_ROOF,20]", 1: "[WORD:MOON] [WORD:ROOF]"}
    assert list(_both(spark, lexicon, ["go moon shiny roof", "moon roof"])) == [want, want]


def test_forms_agree_on_generated_utterances(spark, lexicon):
    import random

    random.seed(11)
    words = "red two door sedan sedans crimson moon roof a the I'd like give me and with twenty one hundred thousand zebra 7 42 @x sedn".split()
    said = [" ".join(random.choice(words) for _ in range(random.randint(1, 9))) for _ in range(150)]
    local, relational = _both(spark, lexicon, said)
    assert local == relational and len(local) == len(said)


def test_index_beyond_the_local_form(spark, lexicon):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "id long, said string")
    rows = lambda tiled: sorted((r["id"], [tuple(t) for t in r["tokens"]]) for r in tiled.collect())
    assert pipeline.is_local(lexicon) and not pipeline.is_local(lexicon, 3)
    assert rows(pipeline.tile(frame, "id", "said", lexicon, most=3)) == rows(pipeline.tile(frame, "id", "said", lexicon))


@pytest.mark.parametrize("most", [None, 3])
def test_any_path_is_accepted(spark, lexicon, most):
    kinds = {"entities": "ENTITY", "quantifiers": "QUANTIFIER", "intents": "INTENT"}
    rows = [(1, "a red sedan", ["[QUANTIFIER:1]", "[ENTITY:RED_SEDAN,20]"]), (2, "a red sedan", ["[NUMBER:1]", "[ENTITY:RED_SEDAN,20]"]),
            (3, "a red sedan", ["[WORD:A]", "[WORD:RED]", "[WORD:SEDAN]"]), (4, "a red sedan", ["[ENTITY:RED_SEDAN,20]"]), (5, None, ["x"]), (6, "zebra", None)]
    tests = spark.createDataFrame(rows, "id int, said string, wanted array<string>")
    got = {r["id"]: r["passed"] for r in pipeline.accepts(tests, "id", "said", "wanted", lexicon, kinds, most).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_report(spark):
    failing = spark.createDataFrame([("7", "x", "[A]", "[B]"), ("8", "y", None, None)], "name string, input string, expected string, observed string")
    tallied = spark.createDataFrame([("b", 1, 2, "1"), ("a", 3, 3, "2")], "suite string, n_passed long, n_run long, priority string")
    rows = R.report(failing, tallied.drop("priority"), tallied.drop("suite"), spark.createDataFrame([(4, 5)], "n_passed long, n_run long"))
    lines = []
    R.print_report(rows, lines.append)
    assert lines == ["7 FAILED\n   input: x\nexpected: [A]\nobserved: [B]", "8 FAILED\n   input: y\nexpected: \nobserved: ", "a: 3/3", "b: 1/2", "1: 1/2", "2: 3/3", "overall: 4/5"]


def test_logger(capsys, caplog):
    from tilery.plans.session import logger

    logger("x", interactive=True)("seen")
    assert capsys.readouterr().out == "seen\n"
    with caplog.at_level("DEBUG", logger="tilery.x"):
        logger("x")("kept")
    assert [r.message for r in caplog.records] == ["kept"]


def test_only_one_machine_gets_a_folder_of_its_own():
    from tilery.plans import session

    class Context:
        master, folder = "local-cluster[3,2,1024]", None

        def getCheckpointDir(self):
            return self.folder

        def getConf(self):
            return {}

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "file:///shared"}
    session.ensure_checkpoint_dir(Session)
    assert Session.sparkContext.folder == "file:///shared"
