import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlytics.operators import trees as T


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(1)
    n = 900
    x = rnd.normal(size=(n, 4))
    x[:, 3] = rnd.integers(0, 3, n)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 3] == 1) + 0.2 * rnd.normal(size=n) + 2
    df = spark.createDataFrame([(i, i % 6 - 1, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, fold int, y double, x0 double, x1 double, x2 double, x3 double").repartition(3)
    edges = T.bin_edges(df.where("fold >= 0"), [F.col(f"x{j}") for j in range(4)])
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    return df, edges, binned, y, np.arange(n) % 6 - 1


def _plain_tree(x, y, depth, least, leaf=1, level=0):
    """Exact search by sums over every cut; returns a function of one row."""
    best = None
    if len(y) >= least and (depth is None or level < depth):
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                a, b = y[x[:, j] <= cut], y[x[:, j] > cut]
                if min(len(a), len(b)) >= leaf:
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y.sum() ** 2 / len(y)
                    if gain > 1e-10 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, j, cut
    if best is None:
        mean = y.mean()
        return lambda row: mean
    _, j, cut = best
    left = x[:, j] <= cut
    low, high = [_plain_tree(x[s], y[s], depth, least, leaf, level + 1) for s in (left, ~left)]
    return lambda row: low(row) if row[j] <= cut else high(row)


def _blocks(frame):
    return T.written(T.binned_blocks(frame[0], frame[1]), "test-blocks")


def _r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_matches_plain_trees(frame):
    _, edges, x, y, fold = frame
    sizes = [len(e) + 1 for e in edges]
    got = T.fit_all(_blocks(frame), sizes, [
        {"kind": "rf", "n_estimators": 1, "bootstrap": False, "held": 2, "min_samples_split": 20},
        {"kind": "rf", "n_estimators": 1, "bootstrap": False, "held": 2, "max_depth": 3, "min_samples_split": 2},
        {"kind": "rf", "n_estimators": 1, "bootstrap": False, "held": 2, "min_samples_leaf": 15},
        {"kind": "gb", "n_estimators": 4, "learning_rate": 0.3, "max_depth": 2, "held": 0, "features": [0, 1, 3]}])
    use, held, test = (fold != -1) & (fold != 2), fold == 2, fold == -1
    for fit, kw in zip(got, (dict(depth=None, least=20), dict(depth=3, least=2), dict(depth=None, least=2, leaf=15))):
        tree = _plain_tree(x[use], y[use], **kw)
        p = np.array([tree(r) for r in x])
        for part, rows in (("held", held), ("train", use), ("test", test)):
            assert T.metrics_of(fit[part])["r2"] == pytest.approx(_r2(y[rows], p[rows]), abs=1e-9)
            assert T.metrics_of(fit[part])["mae"] == pytest.approx(np.abs(y[rows] - p[rows]).mean(), abs=1e-9)
    use, held = (fold != -1) & (fold != 0), fold == 0
    p = np.full(len(y), y[use].mean())
    for _ in range(4):
        tree = _plain_tree(x[use][:, [0, 1, 3]], (y - p)[use], 2, 2)
        p = p + 0.3 * np.array([tree(r) for r in x[:, [0, 1, 3]]])
    assert T.metrics_of(got[3]["held"])["r2"] == pytest.approx(_r2(y[held], p[held]), abs=1e-9)


SOME = [{"kind": "gb", "n_estimators": 12, "learning_rate": 0.2, "max_depth": 2, "held": 0}, {"kind": "gb", "n_estimators": 5, "learning_rate": 0.2, "max_depth": 2, "held": 0},
        {"kind": "rf", "n_estimators": 4, "held": 1, "max_features": "sqrt"}, {"kind": "rf", "n_estimators": 2, "held": 1, "max_features": "sqrt", "max_depth": 3},
        {"kind": "gb", "n_estimators": 3, "num_leaves": 5, "subsample": 0.7, "gamma": 0.2, "reg_lambda": 1.0}]


def test_rounds_over_blocks_agree_with_one_block(frame, monkeypatch):
    sizes = [len(e) + 1 for e in frame[1]]
    whole = T.fit_all(_blocks(frame), sizes, SOME)
    one = {(r.candidate, r.id): r.prediction for r in T.boosted_predictions(_blocks(frame), sizes, SOME[:1]).collect()}
    monkeypatch.setattr(T, "BLOCK_ROWS", 200)
    blocks = _blocks(frame)
    assert blocks.count() > 2
    rounds = T.fit_all(blocks, sizes, SOME)
    for a, b in zip(whole, rounds):
        assert set(a) == set(b) and all(np.allclose(a[k], b[k], rtol=1e-9) for k in a)
    many = {(r.candidate, r.id): r.prediction for r in T.boosted_predictions(blocks, sizes, [{**SOME[0], "n_estimators": 2}, SOME[1]]).collect()}
    five = {(r.candidate, r.id): r.prediction for r in T.boosted_predictions(blocks, sizes, SOME[:1]).collect()}
    assert len(many) == 1800 and five.keys() == one.keys() and all(abs(five[k] - one[k]) < 1e-9 for k in one)


def test_candidates_that_share_trees(frame):
    sizes = [len(e) + 1 for e in frame[1]]
    grid = [{"kind": "rf", "n_estimators": n, "max_depth": d, "min_samples_split": m, "held": 0, "max_features": f} for n in (2, 4) for d in (2, None) for m in (2, 9) for f in ("sqrt", None)]
    assert len(T.shared_growths(grid)) == 2
    together = T.fit_all(_blocks(frame), sizes, grid)
    for c, fit in list(zip(grid, together))[::5]:
        assert np.allclose(T.fit_all(_blocks(frame), sizes, [c])[0]["held"], fit["held"], rtol=1e-9)


@pytest.mark.parametrize("name, value", [("gamma", 30.0), ("num_leaves", 3), ("colsample_bytree", 0.5), ("min_child_weight", 200), ("reg_lambda", 50.0), ("min_samples_split", 300),
                                         ("min_samples_leaf", 100), ("max_features", "sqrt"), ("subsample", 0.5), ("learning_rate", 0.5), ("max_depth", 1)])
def test_each_parameter_changes_the_model(frame, name, value):
    sizes = [len(e) + 1 for e in frame[1]]
    base = {"kind": "gb", "n_estimators": 3, "max_depth": 4, "learning_rate": 0.1}
    a, b = T.fit_all(_blocks(frame), sizes, [base, {**base, name: value}])
    assert not np.allclose(a["train"], b["train"])


def test_unknown_parameters_raise(frame):
    with pytest.raises(ValueError):
        T.fit_all(_blocks(frame), [2] * 4, [{"kind": "gb", "n_estimators": 1, "booster": "dart"}])
    with pytest.raises(ValueError):
        T.fit_all(_blocks(frame).where("false"), [2] * 4, [{"kind": "gb", "n_estimators": 1}])


def test_whole_growth_searches_few_cells_at_a_time_and_agrees_with_rounds(monkeypatch):
    rnd = np.random.default_rng(3)
    n, sizes = 3000, [64, 3, 3, 2, 40, 3, 1]
    x = np.column_stack([rnd.integers(0, s, n) for s in sizes]).astype(np.uint8)
    y, fold = x[:, 0] * 0.1 + (x[:, 1] == 1) * x[:, 4] + rnd.normal(size=n), (np.arange(n) % 6 - 1).astype(np.int32)
    rows = T.Rows(sizes, x.tobytes(), y.tobytes(), fold.tobytes(), np.arange(n).tobytes())
    assert sorted(sum(rows.layout.groups, [])) == list(range(7)) and len(rows.layout.groups) < 7
    place = rnd.integers(0, 2, n)
    got = rows.layout.histogram({"kind": "rf"}, rows.x, np.ones(n), y, place, 2)
    for j, begin in enumerate(rows.layout.start):
        for k in (0, 1):
            use = place == k
            assert got[0, k, begin:begin + sizes[j]].tolist() == np.bincount(x[use, j], minlength=sizes[j]).tolist()
            assert np.allclose(got[2, k, begin:begin + sizes[j]], np.bincount(x[use, j], y[use], sizes[j]))
    monkeypatch.setattr(T, "SEARCH_CELLS", 1000)
    searched, plain = [], T.best_splits
    monkeypatch.setattr(T, "best_splits", lambda hist, *a: searched.append(hist.size // 3) or plain(hist, *a))
    for spec in ({"kind": "rf", "held": 0}, {"kind": "rf", "max_features": "sqrt", "min_samples_leaf": 2}, {"kind": "gb", "num_leaves": 20, "subsample": 0.7}):
        tree, _ = T._grown(rows, spec, 1)
        step, answer = T.growing(spec, 1), None  # the same tree by rounds: all rows are sent down from its root
        try:
            while True:
                same, nodes, uids = step.send(answer)
                answer = plain(rows.histogram(spec, 0, 1, same, nodes), sizes, spec, 1, uids)
        except StopIteration as end:
            same = end.value[0]
        assert all(np.array_equal(a, b) for a, b in zip(tree.plain()[:3], same.plain()[:3])) and np.allclose(tree.value, same.value)
        leaf = rows.leaves(tree)
        used = T.row_weights(spec, 1, rows.key, rows.fold) > 0
        assert (np.bincount(leaf[used], minlength=len(tree.rows))[tree.feature < 0] == tree.rows[tree.feature < 0]).all()
    assert max(searched) <= 1000 and len(searched) > 100


def test_boosted_candidates_share_trees_until_a_stop_parts_them(monkeypatch):
    rnd = np.random.default_rng(5)
    n, sizes = 2000, [64, 30, 3]
    x = np.column_stack([rnd.integers(0, s, n) for s in sizes]).astype(np.uint8)
    y, fold = x[:, 0] * 0.1 + (x[:, 2] == 1) * x[:, 1] + rnd.normal(size=n), (np.arange(n) % 6 - 1).astype(np.int32)
    grown, plain = [], T._grown
    monkeypatch.setattr(T, "_grown", lambda rows, spec, t: grown.append(t) or plain(rows, spec, t))

    def fitted(candidates):
        grown.clear()
        found = {}
        for growth in T.shared_growths(candidates, True):
            rows = T.Rows(sizes, x.tobytes(), y.tobytes(), fold.tobytes(), np.arange(n).tobytes())
            found.update({(i, part): list(v) for i, part, v in T._boost_whole(rows, growth, sizes)})
        return found

    def grid(depth, leaves=None):
        return [{"kind": "gb", "n_estimators": k, "learning_rate": 0.2, "max_depth": depth, "num_leaves": leaves, "held": 0, "subsample": 0.8, "min_samples_split": m}
                for k in (4, 8) for m in (2, 5, 400)]
    for candidates in (grid(7), grid(None, 40)):
        got = fitted(candidates)
        assert len(got) == 4 * len(candidates)
        for i, c in enumerate(candidates):
            assert {part: got[i, part] for k, part in got if k == i} == {part: v for (_, part), v in fitted([c]).items()}
    fitted(grid(1))
    assert grown == list(range(8))  # no stop forbids a root's split: all six share one growth


def test_few_forests_are_dealt_over_many_tasks():
    assert T._chunk([{"n_estimators": 100, "wanted": [(0, 100, 0)]}]) == 2
    assert T._chunk([{"n_estimators": 200, "wanted": [(0, 100, 0), (1, 200, 0)]}] * 20) == 10
    assert T._chunk([{"n_estimators": 3, "wanted": [(0, 3, 0)]}]) == 1


def _random_rows(n, sizes, seed=7):
    rnd = np.random.default_rng(seed)
    x = np.column_stack([rnd.integers(0, s, n) for s in sizes]).astype(np.uint8)
    y, fold = x[:, 0] * 0.1 + (x[:, 1] == 1) * x[:, 2] + rnd.normal(size=n), (np.arange(n) % 6 - 1).astype(np.int32)
    return x, y, fold, T.Rows(sizes, x.tobytes(), y.tobytes(), fold.tobytes(), np.arange(n).tobytes())


def test_small_nodes_are_searched_by_the_bins_of_their_rows(monkeypatch):
    rows = _random_rows(4000, [64, 3, 40, 3, 62, 3, 64])[3]
    searched, plain = [], T.best_splits
    monkeypatch.setattr(T, "best_splits", lambda hist, sizes, *a: searched.append((hist.size // 3, hist.size // 3 // sum(sizes))) or plain(hist, sizes, *a))
    for spec in ({"kind": "rf"}, {"kind": "rf", "max_features": "sqrt", "min_samples_leaf": 2}, {"kind": "rf", "bootstrap": False, "held": 1}):
        searched.clear()
        tree, gains = T._grown(rows, spec, 3)
        cells, nodes = np.sum(searched, axis=0)
        assert cells < nodes * rows.layout.width / 3
        monkeypatch.setattr(T, "SMALL", 0)  # all cells of all nodes
        same, others = T._grown(rows, spec, 3)
        monkeypatch.undo()
        monkeypatch.setattr(T, "best_splits", lambda hist, sizes, *a: searched.append((hist.size // 3, hist.size // 3 // sum(sizes))) or plain(hist, sizes, *a))
        assert all(np.array_equal(a, b) for a, b in zip(tree.plain(), same.plain())) and gains == others


def test_a_forest_tree_grown_by_branches_is_the_whole_tree(monkeypatch):
    rows = _random_rows(5000, [64, 3, 40, 3, 2])[3]
    grown, plain = [], T._grown
    monkeypatch.setattr(T, "_grown", lambda rows, spec, t, root=None: grown.append(len(rows.y)) or plain(rows, spec, t, root))
    for spec in ({"kind": "rf", "stops": [(None, 2), (3, 2), (6, 40), (None, 300)]}, {"kind": "rf", "max_depth": 7, "max_features": "log2", "held": 2, "stops": [(7, 2), (4, 9)]}):
        whole, branches = np.zeros((2, len(spec["stops"]), 5000))
        monkeypatch.setattr(T, "BRANCH_ROWS", 1 << 18)
        shares = T._forest_tree(rows, spec, 1, whole)
        assert np.allclose(whole, rows.forest(spec, plain(rows, spec, 1)[0]))
        grown.clear()
        monkeypatch.setattr(T, "BRANCH_ROWS", 500)
        same = T._forest_tree(rows, spec, 1, branches)
        assert len(grown) > 5 and sorted(grown)[-2] < 3000  # all rows for the top alone
        assert np.allclose(whole, branches, rtol=1e-12) and np.allclose(shares, same)


def test_boosted_trees_in_passes_over_rows_are_those_of_rows_sent_on(monkeypatch):
    x, y, fold, rows = _random_rows(6000, [64, 3, 40, 3, 2])
    monkeypatch.setattr(T, "SLICE_ROWS", 1000)
    scans, plain = [], T._Scan
    monkeypatch.setattr(T, "_Scan", lambda *a: scans.append(a) or plain(*a))
    for spec in ({"held": 1}, {"subsample": 0.7, "min_samples_leaf": 5}, {"max_depth": 6, "max_features": "sqrt", "min_samples_split": 50}):
        spec = {"kind": "gb", "n_estimators": 5, "learning_rate": 0.3, "max_depth": 3, "wanted": [(0, 5, 0)], "stops": [(None, 2)], **spec}
        found = []
        for many in (10, 1 << 20):
            monkeypatch.setattr(T, "PAIRED_ROWS", many)
            rows = T.Rows.of([64, 3, 40, 3, 2], 6000, [(x[a:a + 700].tobytes(), y[a:a + 700].tobytes(), fold[a:a + 700].tobytes(), np.arange(a, min(a + 700, 6000)).tobytes())
                                                      for a in range(0, 6000, 700)])
            found.append({part: v for _, part, v in T._boost_whole(rows, spec, [64, 3, 40, 3, 2])})
        assert found[0].keys() == found[1].keys() and all(np.allclose(found[0][k], found[1][k], rtol=1e-9) for k in found[0])
    assert len(scans) == 15


def test_forest_predictions_travel_in_short_rows_and_rounds_in_waves(frame, monkeypatch):
    sizes, kept, widths = [len(e) + 1 for e in frame[1]], [], []
    forests = [{"kind": "rf", "n_estimators": 4, "held": 0, "max_depth": d} for d in (3, None)]
    whole = T.fit_all(_blocks(frame), sizes, forests)
    plain, rounds = T.written, T._grown_in_rounds
    monkeypatch.setattr(T, "SAID_ROWS", 100)
    monkeypatch.setattr(T, "written", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    again = T.fit_all(_blocks(frame), sizes, forests)
    longest = dict(kept)["tree-chunks"].selectExpr("max(length(sums))").first()[0]
    assert longest == 2 * 100 * 8
    assert all(np.allclose(a[k], b[k], rtol=1e-9) for a, b in zip(whole, again) for k in a)
    monkeypatch.setattr(T, "BLOCK_ROWS", 200)
    monkeypatch.setattr(T, "ROUND_MODELS", 2)
    monkeypatch.setattr(T, "_grown_in_rounds", lambda blocks, sizes, growths: widths.append(len(growths)) or rounds(blocks, sizes, growths))
    T.fit_all(_blocks(frame), sizes, [{"kind": "gb", "n_estimators": 1, "max_depth": d} for d in (1, 2, 3)])
    assert widths == [2, 1]
