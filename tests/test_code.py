from pyspark.sql import functions as F

from verdigraph.operators import code as C
from verdigraph.operators import flow as G
from verdigraph.operators import record


def corpus(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "idx bigint, func string")


def edges_of(spark, source):
    got = G.def_use(corpus(spark, source)).collect()
    return sorted((r["pos"], r["var"], r["rel"], *[(d, p) for d, p in zip(r["deps"] * (len(r["dep_pos"]) if len(r["deps"]) == 1 else 1), r["dep_pos"])]) for r in got)


def test_tokens(spark):
    got = C.tokens(corpus(spark, 'x->y += 0x1Fu; // no\ns = "a;\\"b"; c = \'\\\'\'; i >>= 1e-3;')).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["x", "->", "y", "+=", "0x1Fu", ";", "s", "=", '"a;\\"b"', ";", "c", "=", "'\\''", ";", "i", ">>=", "1e-3", ";"]
    assert [r["kind"] for r in got][:5] == ["ident", "op", "ident", "op", "number"]
    assert [r["pos"] for r in got] == list(range(18))


def test_statements_split_like_tokens(spark):
    source = 'a"b;c\' ; "x;y{" } {;; d \'{\' e "open ; f'
    whole = [r["text"] for r in C.tokens(corpus(spark, source)).orderBy("pos").collect()]
    rows = record.statements(corpus(spark, source), "func").orderBy("stmt").collect()
    assert [t["text"] for r in rows for t in r["tokens"]] == whole
    assert [r["first"] for r in rows] == [sum(len(q["tokens"]) for q in rows[:i]) for i in range(len(rows))]


def test_calls(spark):
    source = "int f(int a) { g(h(a)); p->q . r (1); sizeof(a); int k(int); return m(2); if (a) x[1].z(3); } int after(void);"
    got = C.call_sites(corpus(spark, source)).orderBy("ord").collect()
    assert [r["callee"] for r in got] == ["g", "h", "p->q.r", "m", "x[1].z"]
    source = "void f() { arr[i + 1].run(x); p->ops[j]->go(y); (*fp)(z); if (*p) (q); t[a][b](1); t[u(1)].v(2); }"
    got = C.call_sites(corpus(spark, source)).orderBy("ord").collect()
    assert [r["callee"] for r in got] == ["arr[i+1].run", "p->ops[j]->go", "", "t[a][b]", "u", "v"]


def test_type_names_are_no_identifiers(spark):
    source = "static int f(const struct buf *p, my_t k) { union u v; my_t w = p->n + arr[i].len; (*fp)(w); }"
    df = corpus(spark, source)
    names = {"f", "p", "k", "v", "w", "arr", "i", "fp"}
    assert {r["text"] for r in C.identifiers(C.tokens(df)).collect()} == names
    assert {r["text"] for r in C.function_variables(df).collect()} == names
    assert not {"static", "const", "struct", "buf", "my_t", "union", "u"} & {e[1] for e in edges_of(spark, source)}


def test_call_sentence(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "b"), (3, 3, "a")], "idx bigint, ord int, callee string")
    got = {r["idx"]: r["text"] for r in C.call_sentence(calls).collect()}
    assert got == {
        1: "The program first calls a, ",
        2: "The program first calls a, and finally calls b.",
        3: "The program first calls a, then calls b, and finally calls a.",
    }


def test_variables(spark):
    ids = [(1, x) for x in ("foo", "oo", "b", "p", "q", "vector", "or", "bar", "x")]
    calls = [(1, c) for c in ("foo", "p->b", "q.bar", "vector<x>", "foo_oo")]
    got = C.variables(
        spark.createDataFrame(ids, "idx bigint, text string"), spark.createDataFrame(calls, "idx bigint, callee string")
    ).collect()
    assert sorted(r["text"] for r in got) == ["b", "bar", "oo", "p", "q", "x"]


def test_variables_match_the_pairwise_rule(spark):
    import random
    import re

    rng = random.Random(4)
    names = ["a", "b", "ab", "ba", "aba", "a_b", "b1"]
    ids, calls, want = [], [], set()
    for i in range(300):
        mine = rng.sample(names, 4)
        theirs = ["".join(rng.choice(names + ["->", ".", "<", ">", "*"]) for _ in range(rng.randint(1, 4))) for _ in range(3)]
        ids += [(i, v) for v in mine]
        calls += [(i, c) for c in theirs]
        for v in mine:
            gone = any(
                (re.search(rf"\b{v}", f) and f.endswith(v) and "->" + v not in f and "." + v not in f) or v + "<" in f for f in theirs
            )
            if not gone:
                want.add((i, v))
    got = C.variables(spark.createDataFrame(ids, "idx bigint, text string"), spark.createDataFrame(calls, "idx bigint, callee string"))
    assert {(r["idx"], r["text"]) for r in got.collect()} == want


def test_straight_line_edges(spark):
    got = edges_of(spark, "void f(int a) { b = a + 1; b++; b = b; }")
    # void0 f1 (2 int3 a4 )5 {6 b7 =8 a9 +10 1 11 ;12 b13 ++14 ;15 b16 =17 b18 ;19 }20
    assert (9, "a", "comesFrom", ("a", 4)) in got and (11, "1", "comesFrom") in got
    assert (7, "b", "computedFrom", ("a", 9)) in got and (7, "b", "computedFrom", ("1", 11)) in got
    assert (13, "b", "computedFrom", ("b", 13)) in got
    assert (18, "b", "comesFrom", ("b", 13)) in got and (16, "b", "computedFrom", ("b", 18)) in got
    assert len(got) == 11


def test_updates_pair_all_names_of_a_chain(spark):
    got = edges_of(spark, "{ p->n++; --a[i]; y = p; z = a; }")
    # {0 p1 ->2 n3 ++4 ;5 --6 a7 [8 i9 ]10 ;11 y12 =13 p14 ;15 z16 =17 a18 ;19 }20
    for x in ((1, "p"), (3, "n")):
        for y in ((1, "p"), (3, "n")):
            assert (*x, "computedFrom", (y[1], y[0])) in got
    assert (7, "a", "computedFrom", ("i", 9)) in got and (9, "i", "computedFrom", ("a", 7)) in got and (9, "i", "computedFrom", ("i", 9)) in got
    assert (14, "p", "comesFrom", ("p", 1)) in got and (18, "a", "comesFrom", ("a", 7)) in got


def test_chained_assignments(spark):
    got = edges_of(spark, "{ a = b = c + 1; d = b; int e = f = g; }")
    # {0 a1 =2 b3 =4 c5 +6 1 7 ;8 d9 =10 b11 ;12 int13 e14 =15 f16 =17 g18 ;19
    assert (3, "b", "computedFrom", ("c", 5)) in got and (3, "b", "computedFrom", ("1", 7)) in got
    assert {(1, "a", "computedFrom", ("b", 3)), (1, "a", "computedFrom", ("c", 5)), (1, "a", "computedFrom", ("1", 7))} <= set(got)
    assert not any(e[:3] == (3, "b", "comesFrom") for e in got)
    assert (11, "b", "comesFrom", ("b", 3)) in got
    assert (16, "f", "computedFrom", ("g", 18)) in got and (14, "e", "comesFrom", ("f", 16)) in got and (14, "e", "comesFrom", ("g", 18)) in got


def test_declarations(spark):
    got = edges_of(spark, "{ int x, y; struct s *p = q; my_t z = x; x = y; }")
    # {0 int1 x2 ,3 y4 ;5 struct6 s7 *8 p9 =10 q11 ;12 my_t13 z14 =15 x16 ;17 x18 =19 y20 ;21
    assert got == [
        (2, "x", "comesFrom"), (9, "p", "comesFrom", ("q", 11)), (11, "q", "comesFrom"), (14, "z", "comesFrom", ("x", 16)),
        (16, "x", "comesFrom", ("x", 2)), (18, "x", "computedFrom", ("y", 20)), (20, "y", "comesFrom"),
    ]


def test_targets_and_values_stay_inside_their_brackets(spark):
    got = edges_of(spark, "{ if ((n = g(m)) > k) h(n); }")
    # {0 if1 (2 (3 n4 =5 g6 (7 m8 )9 )10 >11 k12 )13 h14 (15 n16
    assert (4, "n", "computedFrom", ("m", 8)) in got and (4, "n", "computedFrom", ("g", 6)) in got
    assert (12, "k", "comesFrom") in got and not any(e[:3] == (4, "n", "computedFrom") and e[3][1] == 12 for e in got)


EDGE = "idx bigint, pos int, var string, rel string, deps array<string>, dep_pos array<int>"


def test_merge_prune_reindex_align(spark):
    rows = [
        (1, 5, "x", "computedFrom", ["b"], [3]), (1, 5, "x", "computedFrom", ["a"], [4]), (1, 5, "x", "computedFrom", ["a"], [4]),
        (1, 3, "b", "comesFrom", [], []), (1, 4, "a", "comesFrom", [], []), (1, 9, "lone", "comesFrom", [], []), (1, 6, "y", "comesFrom", ["x"], [5, 77]),
    ]
    merged = G.merge_edges(spark.createDataFrame(rows, EDGE))
    five = merged.where("pos = 5").first()
    assert (five["deps"], five["dep_pos"]) == (["a", "b"], [3, 4])
    nodes = G.reindex_edges(G.prune_edges(merged)).orderBy("node").collect()
    assert [(r["var"], r["dep_nodes"], r["dep_vars"]) for r in nodes] == [("b", [], []), ("a", [], []), ("x", [0, 1], ["b", "a"]), ("y", [2], ["x"])]
    aligned = {r["var"]: r["dep_nodes"] for r in G.align_deps(G.reindex_edges(G.prune_edges(merged))).collect()}
    assert aligned["x"] == [1, 0]


def test_repeated_position_stands_for_its_last_node(spark):
    rows = [(1, 2, "x", "computedFrom", ["a"], [1]), (1, 2, "x", "computedFrom", ["b"], [3]), (1, 9, "y", "comesFrom", ["x"], [2])]
    got = {r["node"]: r["dep_nodes"] for r in G.reindex_edges(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {0: [], 1: [], 2: [1]}


def test_flow_sentences(spark):
    rows = [(1, i, "v", "comesFrom", ["v"] if i else [], [i - 1] if i else []) for i in range(21)]
    rows += [(1, 30, "w", "computedFrom", ["a", "b", "v"], [31, 32, 20]), (1, 31, "a", "comesFrom", [], []), (1, 32, "b", "comesFrom", [], []),
             (1, 40, "hidden", "comesFrom", ["a"], [31]), (1, 41, "u", "computedFrom", ["a", "b"], [31, 32]), (1, 42, "v", "comesFrom", ["v"], [19, 20])]
    names = spark.createDataFrame([(1, "v"), (1, "w"), (1, "u")], "idx bigint, text string")
    text = G.flow_sentences(G.align_deps(G.reindex_edges(spark.createDataFrame(rows, EDGE))), names).first()["text"]
    assert text.startswith("The 2nd v comes from the 1st v. The 3rd v comes from the 2nd v. The 4th v comes from the 3rd v. ")
    assert "The 21th v comes from the 20th v. " in text and "hidden" not in text
    assert "The 1st w is computed from the 1st a, the 1st b, and the 21th v. " in text
    assert text.endswith("The 1st u is computed from the 1st a and the 1st b. The 22th v comes from the 20th v and the 21th v. ")


def test_merge_states(spark):
    schema = "idx bigint, var string, def_pos int"
    branches = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "a", 5), (2, "a", 7)], schema)
    entry = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 2)], schema)
    has_else = spark.createDataFrame([(1,)], "idx bigint")
    got = {(r["idx"], r["var"]): r["def_pos"] for r in G.merge_states(branches, entry, has_else).collect()}
    assert got == {(1, "a"): [3, 5], (2, "a"): [1, 7], (2, "b"): [2]}


def test_attention_links(spark):
    rows = [(1, 0, 1, 3, [1], 6, 8), (1, 1, 5, 6, [0, 5], 6, 8)]
    nodes = spark.createDataFrame(rows, "idx bigint, node int, start bigint, `end` bigint, dep_nodes array<int>, node_index bigint, length bigint")
    got = {(r["row"], r["col"]) for r in G.attention_links(nodes).collect()}
    assert got == {(6, 1), (6, 2), (1, 6), (2, 6), (6, 7), (7, 6)}


def test_function_tables_share_one_exchange(spark):
    chain = G.reindex_edges(G.prune_edges(G.def_use(corpus(spark, "{ a = b; }"))))
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def sources(spark, source):
    """(position, name) -> positions it comes from."""
    return {(r["pos"], r["var"]): r["dep_pos"] for r in G.def_use(corpus(spark, source)).where("rel = 'comesFrom'").collect()}


def test_branches_join(spark):
    # {0 x1 =2 1 3 ;4 if5 (6 c7 )8 x9 =10 2 11 ;12 else13 x14 =15 3 16 ;17 u18 =19 x20 ;21 }22
    got = sources(spark, "{ x = 1; if (c) x = 2; else x = 3; u = x; }")
    assert got[(20, "x")] == [9, 14]
    # {0 x1 =2 1 3 ;4 if5 (6 c7 )8 {9 x10 =11 2 12 ;13 }14 u15 =16 x17 ;18 }19
    got = sources(spark, "{ x = 1; if (c) { x = 2; } u = x; }")
    assert got[(17, "x")] == [1, 10]
    # {0 x1 =2 1 3 ;4 if5 (6 a7 )8 x9 =10 2 11 ;12 else13 if14 (15 x16 )17 x18 =19 3 20 ;21 u22 =23 x24 ;25 }26
    got = sources(spark, "{ x = 1; if (a) x = 2; else if (x) x = 3; u = x; }")
    assert got[(16, "x")] == [1] and got[(24, "x")] == [1, 9, 18]
    # The else belongs to the nearer if: {0 x1 =2 1 3 ;4 if5 (6 a7 )8 if9 (10 b11 )12 x13 =14 2 15 ;16 else17 x18 =19 3 20 ;21 u22 =23 x24 ;25 }26
    got = sources(spark, "{ x = 1; if (a) if (b) x = 2; else x = 3; u = x; }")
    assert got[(24, "x")] == [1, 13, 18]
    # First sights in both arms: {0 if1 (2 c3 )4 u5 =6 x7 ;8 else9 u10 =11 x12 ;13 v14 =15 x16 ;17 }18
    got = sources(spark, "{ if (c) u = x; else u = x; v = x; }")
    assert got[(7, "x")] == [] and got[(12, "x")] == [] and got[(16, "x")] == [7, 12]


def test_loops_are_walked_twice(spark):
    # {0 x1 =2 1 3 ;4 while5 (6 x7 )8 {9 y10 =11 x12 ;13 x14 =15 y16 ;17 }18 u19 =20 x21 ;22 }23
    got = sources(spark, "{ x = 1; while (x) { y = x; x = y; } u = x; }")
    assert got[(7, "x")] == [1, 14] and got[(12, "x")] == [1, 14] and got[(16, "y")] == [10] and got[(21, "x")] == [14]
    # The inner loop feeds itself though the outer one starts it anew.
    # {0 while1 (2 a3 )4 {5 j6 =7 0 8 ;9 while10 (11 j12 )13 j14 =15 k16 ;17 }18 }19
    got = sources(spark, "{ while (a) { j = 0; while (j) j = k; } }")
    assert got[(12, "j")] == [6, 14] and got[(3, "a")] == [3] and got[(16, "k")] == [16]
    # for and do are walked once: {0 x1 =2 1 3 ;4 for5 (6 ;7 x8 ;9 )10 x11 =12 2 13 ;14 do15 x16 =17 x18 ;19 while20 (21 x22 )23 ;24 }25
    got = sources(spark, "{ x = 1; for (; x;) x = 2; do x = x; while (x); }")
    assert got[(8, "x")] == [1] and got[(18, "x")] == [11] and got[(22, "x")] == [16]
    # An edge a relation inside a loop: {0 while1 (2 c3 )4 {5 s6 =7 a8 +9 b10 ;11 }12 s13 =14 a15 +16 b17 ;18 }19
    rows = G.def_use(corpus(spark, "{ while (c) { s = a + b; } s = a + b; }")).where("rel = 'computedFrom'").collect()
    assert sorted((r["pos"], r["deps"], r["dep_pos"]) for r in rows) == [(6, ["a", "b"], [8, 10]), (13, ["a"], [15]), (13, ["b"], [17])]


def test_paths_of_pieces(spark):
    source = "int f(int a) { if (a) { g(); } else do x; while (a); switch (a) { case 1: h(); } for (;;) if (b) ; }"
    rows = record.statements(corpus(spark, source)).orderBy("stmt").collect()
    shown = [("".join(t["text"] for t in r["tokens"]), [(p["kind"], p["arm"]) for p in r["path"]], r["header"]) for r in rows]
    assert ("intf(inta){", [], True) in shown and ("g();", [(record.IF, 0)], False) in shown and ("x;", [(record.IF, 1)], False) in shown
    assert ("while(a);", [(record.IF, 1)], False) in shown and ("case1:h();", [], False) in shown
    assert (";", [(record.FOR, 0), (record.IF, 0)], False) in shown and shown[-1] == ("}", [], False)
    assert [c for r in rows for c in r["callees"]] == ["g", "h"]


def test_odd_sources(spark):
    odd = ["", None, "}}} else ) while", "if (", "do", "{ if (a) { b = c; ", "else x = y; }", "while (a) while (b)", "x = {1, 2}; if (q) a = (struct s){1}; y = a;"]
    rows = spark.createDataFrame(list(enumerate(odd)), "idx bigint, func string")
    assert {r["idx"] for r in G.function_flow(rows).collect()} == {5, 6, 7, 8}
    assert G.def_use(rows.limit(0)).count() == 0


def test_branch_states_of_code(spark):
    got = G.branch_states(corpus(spark, "{ x = 1; if (c) x = 2; else { x = 3; y = x; } }")).collect()
    assert sorted((r["branch"], r["arm"], r["var"], r["def_pos"]) for r in got if r["var"] in "xy") == [(5, 0, "x", 9), (5, 1, "x", 15), (5, 1, "y", 19)]


def test_sentences_and_links_take_one_exchange(spark):
    edges = G.reindex_edges(G.prune_edges(G.function_flow(corpus(spark, "{ a = b; }"))))
    for df in (G.flow_sentences(G.align_deps(edges)), G.attention_links(edges.withColumn("node_index", F.col("length")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The distinct links are dealt by all their columns only if their function's place does not do.
        assert plan.count("Exchange hashpartitioning") == 1
        assert "Join" not in plan and plan.count("Scan") == 1


def test_tokens_are_dealt_by_the_size_of_their_text(spark):
    rows = corpus(spark, *["{ a = b; /* " + "x" * 40000 + " */ }"] * 40)
    assert C.tokens(rows).rdd.getNumPartitions() == 4


def test_sentences_need_no_spans(spark):
    rows = corpus(spark, "{ a = b; c = a + a; }", "int f(int n) { if (n) n = g(n); return n; }")
    told = [
        sorted(map(tuple, G.flow_sentences(G.align_deps(G.reindex_edges(G.prune_edges(G.function_flow(rows, placed=p))))).collect())) for p in (True, False)
    ]
    assert len(told[0]) == 2 and told[0] == told[1]
    plain = G.function_flow(rows, placed=False)
    assert plain.columns == G.function_flow(rows).columns[:-3]
    assert "Window" not in plain._jdf.queryExecution().executedPlan().toString()


def test_edges_alone_carry_no_chains(spark):
    assert "chains" not in G.def_use(corpus(spark, "{ a = b; c = a->d; }"))._jdf.queryExecution().optimizedPlan().toString()
    pieces = record.statements(corpus(spark, "{ a = b; }"), "func", names=False)
    assert "chains" not in pieces.columns and "ids" not in pieces.columns


def test_kinds_of_tokens(spark):
    texts = ["(", "->", "+=", "...", ".", ".5", "0x1F", "if", "size_t", "_a", "Z9", '"', '"s"', "'", "'c'", "#", "\\", "é", "", None]
    kinds = ["op", "op", "op", "op", "op", "number", "number", "keyword", "type", "ident", "ident", "op", "string", "op", "char", "op", "op", "op", "op", "op"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r["k"] for r in rows.select("i", C.token_kind(F.col("x")).alias("k")).orderBy("i").collect()] == kinds


def test_values_computed_once_are_not_copied(spark):
    """Steps of folds and transforms copy what they give, so a value bound once stands in the finish of a fold over nothing."""
    plan = G.def_use(corpus(spark, "int f(int a) { while (a) { if (a > 1) a = g(a); else a--; } return a; }"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [bound for bound in ("aggregate(array(", "transform(array(") if bound in plan]


def test_spans_need_no_names(spark):
    rows = corpus(spark, "{ a = b; c = a->d[e]; f(c); }", "int f(int n) { while (n) n = g(n); return n; }")
    cols = ["idx", "pos", "var", "rel", "deps", "dep_pos", "start", "end", "length"]
    bare = G.function_flow(rows, names=False)
    assert "chains" not in bare._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, bare.select(cols).collect())) == sorted(map(tuple, G.function_flow(rows).select(cols).collect()))
    assert bare.where("end > start").count() > 0


def test_sentences_unroll_no_edges(spark):
    """Edges of a function find each other in its one row: nothing is unrolled, and one window counts occurrences."""
    edge = "idx int, node int, var string, rel string, deps array<string>, dep_nodes array<int>, told boolean"
    rows = [
        (1, 0, "a", "comesFrom", [], [], True), (1, 1, "b", "computedFrom", ["a"], [0], True), (1, 3, "a", "comesFrom", ["a", "b"], [0, None, 1, 2], True),
        (1, 5, "b", "comesFrom", ["a", None], [3, 1, 5], True), (1, 6, "c", "comesFrom", ["c"], [9], True), (1, 7, "d", "comesFrom", ["b"], [5], False),
        (2, 0, "x", "comesFrom", ["x"], [], True), (None, 0, "y", "comesFrom", ["y"], [0], True), (3, 0, "z", "comesFrom", None, None, True), (3, 1, "z", "comesFrom", ["z"], [0], None),
    ]
    told = G.flow_sentences(spark.createDataFrame(rows, edge))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("+- Window") == 1
    got = {r["idx"]: r["text"] for r in told.collect()}
    first = "The 1st b is computed from the 1st a. The 2nd a comes from the 1st a and the 1st a. "
    assert got == {1: first + "The 2nd b comes from the 2nd a, and the 2nd a. ", None: "The 1st y comes from the 1st y. "}


def test_names_of_chains(spark):
    source = "struct s f(my_t *p, int n) { p->a[i].b = q[j] + n; r.x = if_ + Z9; g(p->h(n)); my_t w; }"
    rows = record.statements(corpus(spark, source)).orderBy("stmt").collect()
    assert sorted({i for r in rows for i in r["ids"]}) == ["Z9", "f", "g", "i", "if_", "j", "my_t", "n", "p", "q", "r", "w"]
    texts = ["", "a", "_", "9", "if", "int", "a->b", "(", "é", None]
    marked = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    both = marked.select((C.token_kind(F.col("x")) == "ident").alias("k"), C.is_ident(F.col("x")).alias("j")).collect()
    assert all(r["k"] == r["j"] for r in both)
