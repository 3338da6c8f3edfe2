"""Vectors go once to an area, not once to each cell that they visit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import multi_index


def brute(x, least=0.95):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while True:
        low = np.array([min([c, *component[near[i]]]) for i, c in enumerate(component)])
        if (low == component).all():
            return [(i, int(n), int(c), bool(c == i)) for i, (n, c) in enumerate(zip(near.sum(1), component, strict=True))]
        component = low


@pytest.mark.parametrize("held,tile,passing", [(1 << 22, 2048, 1 << 20), (40 * 16, 16, 1 << 20), (40 * 16, 64, 90)])
def test_areas_pieces_and_turns_find_every_link(spark, monkeypatch, held, tile, passing):
    for name, value in (("HELD", held), ("TILE", tile), ("PASSING", passing), ("CELL", 8), ("STEP", 32)):
        monkeypatch.setattr(multi_index, name, value, raising=False)
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 16))
    x[200:300] = x[:100] + 0.06 * draw.standard_normal((100, 16))
    x[300:400] = x[5] + 0.1 * draw.standard_normal((100, 16))  # a crowded cell
    x[::3] = x[::3].astype(np.float32)  # of four bytes a component; the others need eight
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    made, old = [], multi_index._sent
    monkeypatch.setattr(multi_index, "_sent", lambda cells, books, limit, areas: made.append((old(cells, books, limit, areas), areas)) or made[-1][0])
    got = sorted(tuple(r) for r in multi_index.near_duplicates(frame).collect())
    assert got == brute(x)
    sent, areas = made[0]
    # 49 cells, some 20 of them visited by a vector; it is sent once a turn and once to each piece of an area.
    assert sent.count() <= 400 * (areas.turns + areas.pieces.sum())
    assert held > 1000 or areas.pieces.max() > 1 and len(areas.starts) > 3
    assert passing > 90 or areas.turns > 4
    rows = sent.where("visits IS NOT NULL").groupBy("home", "rep").count()
    assert rows.where("count > 1").count() == 0


def test_packed_vectors_are_exact():
    x = np.random.default_rng(0).standard_normal((5, 3))
    short = x.astype(np.float32).astype(np.float64)
    assert (multi_index.unpacked(multi_index.packed(x), 3) == x).all()
    both = pa.concat_arrays([multi_index.packed(short), multi_index.packed(x), multi_index.packed(short[:0])])
    assert (multi_index.unpacked(both, 3) == np.concatenate([short, x])).all() and len(both[0].as_py()) == 12
    assert (multi_index.unpacked(multi_index.packed(np.array([[1e300, 0.1]])), 2) == [[1e300, 0.1]]).all()


def test_areas_are_runs_of_cells_and_a_crowded_one_is_cut():
    members = np.array([5, 0, 3, 100, 2, 2, 0, 9])
    areas = multi_index.areas_of(members, multi_index.HELD // 10, 1)
    assert (np.diff(areas.of) >= 0).all() and areas.of[areas.starts].tolist() == list(range(len(areas.starts)))
    assert areas.used.tolist() == (members > 0).tolist()
    held = np.bincount(areas.of, members)
    assert all(h / p <= 20 for h, p in zip(held, areas.pieces, strict=True)) and areas.pieces.max() > 1
    assert areas.groups == areas.pieces.sum() * areas.turns
