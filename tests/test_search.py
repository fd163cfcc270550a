"""Search on grids: the bucket queue against a plain queue, tiles against a search over the whole grid."""

import heapq

import numpy as np
import pytest

from pathloom.operators import search, tiles


def plain(floor, source):
    best, queue = {source: 0}, [(0, source)]
    while queue:
        d, (i, j) = heapq.heappop(queue)
        for di, dj in search.NEAR:
            to = i + di, j + dj
            step = d + (search.DIAGONAL if di and dj else search.STRAIGHT)
            if 0 <= to[0] < floor.shape[0] and 0 <= to[1] < floor.shape[1] and floor[to] and d == best[i, j] and step < best.get(to, search.FAR):
                best[to] = step
                heapq.heappush(queue, (step, to))
    out = np.full(floor.shape, -1)
    for at, d in best.items():
        out[at] = d
    return out


def scene(seed, shape, share):
    rng = np.random.default_rng(seed)
    floor = rng.random(shape) < share
    return floor, np.argwhere(floor)[rng.permutation(int(floor.sum()))[:4]]


@pytest.mark.parametrize(("seed", "shape", "share"), [(1, (1, 1), 1.0), (2, (9, 14), 0.6), (3, (30, 7), 0.75), (4, (17, 23), 1.0), (5, (25, 25), 0.5)])
def test_bucket_queue(seed, shape, share):
    floor, sources = scene(seed, shape, share)
    got = search.distances(floor, sources)
    for k, source in enumerate(sources):
        want = plain(floor, tuple(source))
        assert (got[k] == want).all()
        goal = tuple(np.argwhere(want == want.max())[0])
        path = search.walked(got[k], goal)
        assert path[0] == tuple(source) and path[-1] == goal
        assert sum(search.DIAGONAL if a != c and b != d else search.STRAIGHT for (a, b), (c, d) in zip(path, path[1:])) == want.max()
    most = int(3.5 * search.STRAIGHT)
    assert (search.distances(floor, sources, most) == np.where(got <= most, got, -1)).all()


def test_packed_rows(spark):
    floor, _ = scene(6, (5, 200), 0.5)
    rows = search.packed(spark.createDataFrame([(3, int(i), int(j)) for i, j in np.argwhere(floor)], "scene_id long, i int, j int")).toPandas()
    assert (search.unpacked(*(rows[c].to_numpy() for c in ("i", "block_j", "bits")), floor.shape)[:5, :200] == floor).all()


@pytest.mark.parametrize("side", [3, 7, 64])
def test_tiles_equal_one_search(spark, side):
    """Two scenes over many tiles, four sources each: distances and paths of all cells that are reached."""
    scenes = {1: scene(7, (13, 20), 0.65), 2: scene(8, (16, 9), 0.8)}
    floor = spark.createDataFrame([(s, int(i), int(j)) for s, (f, _) in scenes.items() for i, j in np.argwhere(f)], "scene_id long, i int, j int")
    asked = [(s, int(a), int(b), int(i), int(j)) for s, (f, sources) in scenes.items() for a, b in sources for i, j in np.argwhere(f)]
    questions = spark.createDataFrame([(s, k, *cells) for k, (s, *cells) in enumerate(asked)], "scene_id long, q long, i1 int, j1 int, i2 int, j2 int")
    wall = spark.createDataFrame([(1, 500, 500)], "scene_id long, si int, sj int")  # a source that is no floor
    held = tiles.spread(floor, questions.select("scene_id", questions.i1.alias("si"), questions.j1.alias("sj")).unionByName(wall), side=side)
    want, paths = {}, {}
    for k, (s, a, b, i, j) in enumerate(asked):
        found = search.distances(scenes[s][0], np.array([[a, b]]))[0]
        if found[i, j] >= 0:
            want[s, k], paths[s, k] = int(found[i, j]), search.walked(found, (i, j))
    assert {(r.scene_id, r.q): r.steps for r in tiles.lengths(held, questions, side).collect()} == want
    some = questions.filter("q % 5 = 0")
    assert {(r.scene_id, r.q): [tuple(c) for c in r.path] for r in tiles.ways(held, some, side).collect()} == {k: p for k, p in paths.items() if k[1] % 5 == 0}


def test_tiles_of_nothing(spark):
    floor = spark.createDataFrame([], "scene_id long, i int, j int")
    sources = spark.createDataFrame([(1, 0, 0)], "scene_id long, si int, sj int")
    assert tiles.spread(floor, sources).count() == 0
