"""Vector operators against all pairs; tool calls against a plain walk."""

import json

import numpy as np
import pytest

from hedgewatch.llm import neighbours, queries, toolcalls, topk

VECTORS = "vec_id long, embedding array<float>, label int, score int, id string"


def clouds(seed=1, groups=(300, 40, 2, 2, 1), width=16, spread=0.03, rest=300):
    draw = np.random.default_rng(seed)
    rows = [c + spread * draw.standard_normal(width) for n in groups for c in [draw.standard_normal(width)] for _ in range(n)]
    return np.array([*rows, *draw.standard_normal((rest, width))], np.float32)


def slow_links(rows):
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def check(found, rows, least_recall=1.0):
    near = slow_links(rows)
    parent = list(range(len(rows)))
    for _ in rows:
        after = [min([parent[i], *[parent[j] for j in np.flatnonzero(near[i])]]) for i in range(len(rows))]
        if after == parent:
            break
        parent = after
    got = sorted(found, key=lambda r: r["vec_id"])
    links = np.array([r["n_links"] for r in got])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= least_recall * near.sum()
    if least_recall == 1:
        assert [r["component_id"] for r in got] == parent
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_duplicate_vectors(spark):
    rows = clouds()
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(rows)], VECTORS)
    check(neighbours.near_duplicates(df).collect(), rows)


def test_chains_meet_in_blocks(spark, monkeypatch):
    """A component wider than its core, in small blocks."""
    monkeypatch.setattr(neighbours, "MEETING", 16)
    angle = np.linspace(0, 1.5, 120)
    rows = np.stack((np.cos(angle), np.sin(angle), 0 * angle), axis=1).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(rows)], VECTORS)
    check(neighbours.near_duplicates(df).collect(), rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1.0], [0.0, 1e-30]]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(odd)] + [(6, [1.0, 0.0], 0, 0, "")], VECTORS)
    rows = sorted(map(tuple, neighbours.near_duplicates(df).collect()))
    expected = [(i, 0, i, True) for i in range(12)][:6] + [(6, 3, 6, True), (6, 3, 6, True), (7, 3, 6, False), (8, 3, 6, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert rows == expected
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_block_links_join_their_components():
    """The edge 2-3 is neither row's first nor last, and in no list: its ends have better neighbours."""
    scores = np.zeros((6, 6))
    for i, j in ((2, 0), (2, 5), (3, 1), (3, 4)):
        scores[i, j] = scores[j, i] = 0.99
    scores[2, 3] = scores[3, 2] = 0.91
    for doubt in (0.91, 0.9):  # 0.9 may turn out to be below the threshold: it goes on, to be checked
        scores[2, 3] = scores[3, 2] = doubt
        row, column, _, link = neighbours._pairs(np.arange(6), scores.copy(), 1, np.full(6, 2.0), 0.9 - neighbours.MARGIN)
        assert link.all() and len(row) == 5 and {2, 3} in [{int(a), int(b)} for a, b in zip(row, column, strict=True)]


def test_dense_groups_joined_by_one_bridge():
    """Two groups of 20 near copies; the sure links alone give the components whatever the doubtful ones are worth."""
    draw = np.random.default_rng(3)
    scores = np.full((41, 41), 0.2)
    scores[:20, :20] = scores[20:40, 20:40] = 0.99
    scores[10, 30] = scores[30, 10] = 0.92
    scores[40, 5] = scores[5, 40] = 0.899
    order = draw.permutation(41)
    row, column, score, link = neighbours._pairs(order, scores[order][:, order].astype(np.float32), 8, np.full(41, -2.0), 0.9 - neighbours.MARGIN)
    kept = [(a, b) for a, b, s, own in zip(row.tolist(), column.tolist(), score, link, strict=True) if own and s >= 0.9]
    group = {n: {n} for n in range(41)}
    for a, b in kept:
        both = group[a] | group[b]
        group.update(dict.fromkeys(both, both))
    assert group[0] == set(range(40)) and group[40] == {40}


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(rows)], VECTORS)


def test_audit_sees_small_groups(spark):
    """A large group is found, every pair is lost; copies of a vector are no links found."""
    rows = clouds(5, (60, *[2] * 20), rest=20)
    near, raw = slow_links(rows), neighbours.usable_vectors(vectors_of(spark, rows))
    nodes = raw.selectExpr("vec_id AS id", "raw", "IF(vec_id < 60, 1L, 5L) AS copies").cache()
    found = [(i, int(near[i].sum()) if i < 60 else 4) for i in range(len(rows))]
    assert neighbours.recall(nodes, spark.createDataFrame(found, "id long, links long"), 0.9) == 0
    whole = [(i, int(near[i] @ np.where(np.arange(len(rows)) < 60, 1, 5)) + (0 if i < 60 else 4)) for i in range(len(rows))]
    assert neighbours.recall(nodes, spark.createDataFrame(whole, "id long, links long"), 0.9) == 1


def test_all_vectors_meet_if_the_search_fails(spark, monkeypatch):
    rows = clouds(6, (40, 2, 2, 2), rest=60)
    search = neighbours.first_neighbours
    monkeypatch.setattr(neighbours, "MEETING", 16)
    monkeypatch.setattr(neighbours, "DOUBLINGS", 0)
    monkeypatch.setattr(neighbours, "first_neighbours", lambda *x: search(*x).where("false"))
    check(neighbours.near_duplicates(vectors_of(spark, rows)).collect(), rows)


def slow_top(ids, rows, queries_at, k):
    scores = rows @ rows.T
    out = []
    for q in queries_at:
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-scores[q, i], ids[i]))[:k]
        out += [(int(ids[q]), n + 1, int(ids[i]), int(scores[q, i])) for n, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("ties", [False, True])
def test_top_k(spark, ties):
    draw = np.random.default_rng(4)
    rows = draw.standard_normal((700, 6)).astype(np.float32)
    if ties:
        rows[100:400] = rows[7]
    whole = np.floor(rows.astype(float) * 64)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, 0, "") for i, r in enumerate(rows)], VECTORS)
    vectors = topk.integer_vectors(df)
    found = topk.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, shard_rows=90, block_queries=12)
    assert sorted(map(tuple, found.collect())) == slow_top(np.arange(700), whole, range(0, 700, 20), 20)


def test_top_k_of_odd_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, ""), (1, None, 0, 0, ""), (20, [1e30, 1.0], 0, 0, ""), (3, [nan, 1.0], 0, 0, ""), (4, [None, 1.0], 0, 0, ""),
                                (5, [1.0], 0, 0, ""), (None, [1.0, 1.0], 0, 0, ""), (7, [1.0, 2.0], 0, 0, ""), (7, [1.0, 2.0], 0, 0, "")], VECTORS)
    rows = sorted(map(tuple, topk.search_every(df).collect()))
    most = np.iinfo(np.int64).max
    assert [r[:3] for r in rows] == [(0, 1, 20), (0, 2, 7), (0, 3, 7), (0, 4, 5), (20, 1, 0), (20, 2, 5), (20, 3, 7), (20, 4, 7)]
    assert rows[0][3] == most and rows[1][3] == 64 * 64 + 128 * 128
    assert topk.search_every(df.limit(0)).count() == 0


def test_pruning_leaves_the_result(spark):
    """Clustered vectors, where boxes rule leaves out."""
    ids, rows = np.arange(600), np.floor(64 * clouds(2, (100,) * 5, 4, 0.05, 100).astype(float))
    tree = topk.Tree(ids, rows, leaf=20)
    visited = []
    visit = tree._visit
    tree._visit = lambda node, *rest: (visited.append(node), visit(node, *rest))[1]
    for q in (0, 250, 599):
        visited.clear()
        at, names, scores = tree.search(ids[q:q + 1], rows[q:q + 1], np.array([-np.inf]), 5)
        assert [(int(i), n + 1, int(j), int(s)) for n, (i, j, s) in enumerate(zip(ids[[q] * len(at)], names, scores, strict=True))] == slow_top(ids, rows, [q], 5)
        assert len(visited) < tree.first_leaf + 1


def test_far_shards_are_not_sent_for(spark, monkeypatch):
    """Shards whose boxes allow nothing never meet a block; results are those of all pairs, however many rows are equal."""
    rows = np.floor(64 * clouds(3, (150,) * 6, 8, 0.02, 150).astype(float))
    rows[:200] = rows[0]
    ids = np.arange(len(rows))
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows, strict=True)], "vec_id long, vector array<double>")
    sent = []
    kept = topk._meetings
    monkeypatch.setattr(topk, "_meetings", lambda blocks, forest: (sent.append((kept(blocks, forest).count(), blocks.count() * (forest.count() - 1))), kept(blocks, forest))[1])
    found = topk.nearest(df, df.where("vec_id % 20 = 0"), 5, shard_rows=60, block_queries=6)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == sorted(slow_top(ids, rows, [int(i) for i in ids if i % 20 == 0], 5))
    assert 0 < sent[0][0] < sent[0][1]


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level int, place string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


def test_calls_are_linked_in_order(spark):
    tools = {"t": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer"}, "a": {"enum": ["x"]}}, "additionalProperties": False}}
    calls = spark.createDataFrame([
        (1, 1, "a", "t", '{"b": 1.0, "a": "x"}', ["c"], 0, ""), (1, 3, "b", "t", '{"b": "1", "z": 2}', [], 0, ""), (1, 5, "c", "u", "{oops", ["b", "gone"], 0, ""),
        (1, 7, "r1", "t", '{"b": 2}', ["r2"], 0, ""), (1, 9, "r2", "t", '{"b": 2}', ["r1"], 0, ""), (1, 11, "late", "t", '{"b":1,"b":2}', ["r1"], 0, ""),
        (1, 13, "a", "t", '{"b": 9}', [], 0, ""), (2, 1, "a", "t", None, None, 0, ""), (None, 1, "a", "t", "{}", [], 0, ""), (2, None, None, "t", "{}", [], 0, "")], CALLS)
    results = spark.createDataFrame([(1, 2, "a", "é\n\"x\"", ""), (1, 4, "a", "second", ""), (1, 6, "lost", "nobody asked", ""), (1, 8, "c", None, ""), (3, 1, "a", "alone", "")], RESULTS)
    rows = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link_calls(calls, results, tools).collect()}
    order = [k for k, _ in sorted(rows.items(), key=lambda x: (x[0][0], x[1]["place"]))]
    assert order == [(1, "b"), (1, "c"), (1, "a"), (1, "r1"), (1, "r2"), (1, "late"), (1, "lost"), (2, "a"), (3, "a")]
    assert [r["place"] for r in (rows[k] for k in order)] == [0, 1, 2, 3, 4, 5, 6, 0, 0]
    assert {k[1]: r["status"] for k, r in rows.items() if k[0] == 1} == {
        "a": "linked", "b": "unanswered", "c": "linked", "r1": "circular", "r2": "circular", "late": "circular", "lost": "orphan"}
    assert rows[1, "a"]["json"] == '{"after":["c"],"arguments":{"a":"x","b":1},"id":"a","name":"t","result":"é\\n\\"x\\""}'
    assert rows[1, "b"]["problems"] == ["$.b: not integer", "$.z: unknown"]
    assert rows[1, "c"]["problems"] == ["$: unknown tool", "$: not JSON"] and rows[1, "late"]["problems"] == ["$: not JSON"]
    assert rows[2, "a"]["problems"] == ["$: not JSON"] and rows[3, "a"]["status"] == "orphan"
    assert toolcalls.link_calls(calls.limit(0), results.limit(0), tools).count() == 0


def _slow_levels(needs):
    """Levels by their definition, round by round until nothing changes."""
    level = {}
    while True:
        ready = {c: max([level[n] + 1 for n in after if n in needs], default=0) for c, after in needs.items()
                 if c not in level and all(n in level for n in after if n in needs)}
        if not ready:
            return {c: level.get(c) for c in needs}
        level |= ready


@pytest.mark.parametrize("at_once", [0, 20, 50_000])
def test_levels_by_brute_force(spark, monkeypatch, at_once):
    """Conversations in one task, in rounds, and both; with circles, repeated calls, unknown and null references."""
    monkeypatch.setattr(toolcalls, "REFERENCES_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    rows, needs = [], {}
    for conv in range(12):
        for i in range(3 + 2 * conv):
            name = f"c{i if rng.random() < 0.9 else max(i - 1, 0)}"
            after = [f"c{rng.integers(0, i + (2 if rng.random() < 0.1 else 0) + 1)}" for _ in range(rng.integers(0, 3))]
            after = None if i == 2 else [a for a in after if a != name or conv == 5] + (["gone"] if i % 4 == 1 else [None] if i % 4 == 3 else [])
            rows.append((conv, name, after))
            needs.setdefault((conv, name), set()).update(after or ())
    found = toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>").repartition(5)).collect()
    expected = {}
    for conv in range(12):
        slow = _slow_levels({c: after for (v, c), after in needs.items() if v == conv})
        expected |= {(conv, c): n for c, n in slow.items()}
    assert len(found) == len(expected) and {(r["conv_id"], r["call_id"]): r["level"] for r in found} == expected
    assert None in expected.values() and max(n for n in expected.values() if n is not None) > 3


def test_a_chain_of_thousands_is_one_task(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "_levels_in_rounds", None)
    calls = spark.range(5000).selectExpr("7L AS conv_id", "concat('c', id) AS call_id", "array(concat('c', id - 1)) AS after")
    assert {r["level"] for r in toolcalls.levels(calls).collect()} == set(range(5000))
    assert toolcalls.levels(calls.limit(0)).count() == 0


def test_long_chain_and_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "TURNS_AT_ONCE", 4)
    calls = spark.createDataFrame([(1, 40 - i, f"c{i:02}", "t", "{}", [f"c{i - 1:02}"] if i % 6 else [], 0, "") for i in range(40)], CALLS)
    rows = sorted(toolcalls.link_calls(calls, spark.createDataFrame([], RESULTS), {"t": {}}).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(40))
    assert [r["level"] for r in rows] == sorted(i % 6 for i in range(40))
    place = {r["call_id"]: r["place"] for r in rows}
    assert all(place[f"c{i - 1:02}"] < place[f"c{i:02}"] for i in range(40) if i % 6)


def test_op1_every_turn_once(spark, sf_dir):
    rows = queries.op1_tool_call_linking(spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    has = {(r["conv_id"], r["turn"]) for r in turns if r["role"] == "assistant"}
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in turns}
    assert sum(r["status"] != "orphan" for r in rows) == len(has)
    for r in rows:
        value = json.loads(r["json"])
        assert toolcalls.canonical_json(value) == r["json"]
        if r["status"] in ("linked", "orphan"):
            assert value["result"] == texts[r["conv_id"], r["result_turn"]]
            assert (r["status"] == "linked") == ((r["conv_id"], r["result_turn"] - 1) in has)
    by = {(r["conv_id"], r["call_id"]): r for r in rows}
    for (conv, _), r in by.items():
        for needed in json.loads(r["json"]).get("after", []):
            if r["level"] is not None and (conv, needed) in by and by[conv, needed]["status"] != "orphan":
                assert by[conv, needed]["place"] < r["place"]


def test_canonical_numbers():
    assert toolcalls.canonical_json({"b": [1.0, 1.5, True, None, "é/\u0001"], "a": {}}) == '{"a":{},"b":[1,1.5,true,null,"é/\\u0001"]}'
    with pytest.raises(ValueError, match="NaN"):
        toolcalls.parsed("NaN")
    with pytest.raises(ValueError, match="twice"):
        toolcalls.parsed('{"a":1,"a":1}')
