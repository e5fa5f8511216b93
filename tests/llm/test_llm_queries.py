"""The registered queries of the subpackage: against SQL where there is some, else against plain Python."""

import zlib

import duckdb
import numpy as np
import pytest
from compare import differences, duck

from foldwright.llm.queries import ORACLES, QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(df, connection, ORACLES[name]) == ""


def rows_of(sf_dir, sql):
    return duckdb.connect().execute(sql.replace("FROM ", f"from '{sf_dir}/").replace(" END", ".parquet'")).fetchall()


def test_native_query_has_no_python(spark, sf_dir):
    plan = QUERIES["op5_quotation_threads"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_threads_without_quotes_are_the_conversations(spark, sf_dir):
    got = QUERIES["op5_quotation_threads"](spark, sf_dir).toPandas().sort_values(["conv_id", "turn"])
    texts = rows_of(sf_dir, "select conv_id, turn, text FROM conversations END order by conv_id, turn")
    assert not any(line.lstrip().startswith(">") for _, _, t in texts for line in (t or "").split("\n"))
    assert list(zip(got.conv_id, got.turn)) == [(c, t) for c, t, _ in texts]
    assert (got.depth == 0).all() and (got.thread_conv == got.conv_id).all()
    assert (got.groupby("conv_id").cumcount() + 1 == got.position).all()


def test_neighbours_recall_and_scores(spark, sf_dir):
    got = QUERIES["op6_one_bit_neighbours"](spark, sf_dir).collect()
    rows = rows_of(sf_dir, "select vec_id, embedding FROM embeddings END")
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    place, found = {v: i for i, v in enumerate(ids)}, {}
    for r in got:
        assert abs(unit[place[r["query_id"]]] @ unit[place[r["vec_id"]]] - r["score"]) < 1e-12
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[place[q]]
        score[place[q]] = -2
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(found[q]))
    assert hits >= 0.9 * 5 * len(ids[ids % 50 == 0])


def test_packing_is_whole_and_dense(spark, sf_dir):
    from tokenizers import Tokenizer

    got = QUERIES["op7_best_fit_packing"](spark, sf_dir).toPandas()
    tokenizer, expected = Tokenizer.from_file(tokenizer_path()), {}
    for doc_id, text in rows_of(sf_dir, "select doc_id, text FROM documents END"):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            expected[doc_id, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 2048) + 1


def test_quality_on_held_out_rows(spark, sf_dir):
    # The smallest table has some 60 labels to learn from, fewer than there are kinds of junk to see.
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, sf_dir).collect()}
    labels = dict(rows_of(sf_dir, "select doc_id, quality FROM labels END"))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    tested = [i for i in labels if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in tested]) >= 0.95


def test_mix_reaches_its_targets(spark, sf_dir):
    got = QUERIES["op9_mixing"](spark, sf_dir).toPandas()
    again = QUERIES["op9_mixing"](spark, sf_dir).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()
    texts = {i: (t, s) for i, t, s in rows_of(sf_dir, "select doc_id, text, source FROM documents END")}
    assert sorted(got.doc_id) == sorted(texts)
    sizes, totals = {}, {}
    for i, (text, source) in texts.items():
        sizes[i] = len((text or "").encode().split())
        totals[source] = totals.get(source, 0) + sizes[i]
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(totals, key=lambda s: (s is None, (s or "").encode())))}
    capped, targets = set(), {}
    while True:
        spent = sum(3 * totals[s] for s in capped)
        level = (sum(totals.values()) - spent) / sum(weights[s] for s in totals if s not in capped)
        targets = {s: 3 * totals[s] if s in capped else level * weights[s] for s in totals}
        above = {s for s in totals if targets[s] > 3 * totals[s]}
        if not above:
            break
        capped |= above
    for r in got.itertuples():
        source = texts[r.doc_id][1]
        assert r.size == sizes[r.doc_id] and r.source_size == totals[source]
        assert abs(r.target - targets[source]) < 1e-6 * max(targets[source], 1)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    for source, rows in got.groupby(got.doc_id.map(lambda i: texts[i][1]), dropna=False):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max()


def test_line_dedup_equals_all_pairs(spark, sf_dir):
    import hashlib

    from foldwright.llm.lines import _plain_distance, within_edits

    texts = dict(rows_of(sf_dir, "select doc_id, text FROM documents END"))
    first = {}
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, n))
    lines, parent = sorted(first, key=len), {x: x for x in first}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            if within_edits(a, b, 2):
                assert len(a) > 2000 or _plain_distance(a, b) <= 2
                parent[top(a)] = top(b)
    kept = {}
    for line in lines:
        kept[top(line)] = min(kept.get(top(line), first[line]), first[line])
    for r in QUERIES["op10_line_dedup"](spark, sf_dir).collect():
        own = (texts[r["doc_id"]] or "").split("\n")
        left = [x for n, x in enumerate(own) if len(x) < 20 or kept[top(x)] == (r["doc_id"], n)]
        assert (r["n_lines"], r["n_removed"]) == (len(own), len(own) - len(left))
        assert r["kept_md5"] == hashlib.md5("\n".join(left).encode()).hexdigest()


def test_no_exact_repeat_is_left(spark, sf_dir):
    texts = dict(rows_of(sf_dir, "select doc_id, text FROM documents END"))
    short = set()
    repeats = dict.fromkeys(texts, 0)
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            if len(line) < 20 and line.strip():
                repeats[i] += line in short
                short.add(line)
    without = {r["doc_id"]: r["n_removed"] for r in QUERIES["op10_line_dedup"](spark, sf_dir).collect()}
    whole = {r["doc_id"]: r["n_removed"] for r in QUERIES["op10_line_dedup_short"](spark, sf_dir).collect()}
    assert whole == {i: without[i] + repeats[i] for i in texts} and sum(repeats.values()) == 69
