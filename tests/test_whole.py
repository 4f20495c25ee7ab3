"""Queries that once left out a part of their tables."""

import math

import pytest

from blockloom.plans import layouts, sequences


def by_block(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.block_id, []).append(r)
    return out


def test_all_slots_of_a_block(spark, folder):
    slots = by_block(sequences.slots(spark, folder))
    assert max(r.slot_id for rows in slots.values() for r in rows) >= 24
    every = {(b, r.slot_id) for b, rows in slots.items() for r in rows}
    assert {(r.block_id, r.id) for r in layouts.repelled(spark, folder).collect()} == every
    matched = layouts.slot_matching(spark, folder).collect()
    assert {(r.block_id, r.target_id) for r in matched} == every
    assert len({(r.block_id, r.slot_id) for r in matched}) == len(matched)
    collisions = {r.block_id: r.collision for r in layouts.collisions(spark, folder).collect()}
    kept = {}
    for b, rows in slots.items():
        s = sum(max(0, 0.2 - math.dist((p.posx, p.posy), (q.posx, q.posy))) ** 2 for p in rows for q in rows if p.slot_id < q.slot_id)
        assert collisions[b] == pytest.approx(s / max(len(rows) * (len(rows) - 1) / 2, 1))
        kept[b] = []
        score = lambda r: 0.0 if r.a_i is None or math.isnan(r.a_i) else r.a_i
        for r in sorted(rows, key=lambda r: (-score(r), r.slot_id)):
            for k in kept[b]:
                ix = max(0, min(r.posx + r.size_x / 2, k.posx + k.size_x / 2) - max(r.posx - r.size_x / 2, k.posx - k.size_x / 2))
                iy = max(0, min(r.posy + r.size_y / 2, k.posy + k.size_y / 2) - max(r.posy - r.size_y / 2, k.posy - k.size_y / 2))
                union = r.size_x * r.size_y + k.size_x * k.size_y - ix * iy
                if ix * iy > 0.1 * union or math.dist((r.posx, r.posy), (k.posx, k.posy)) < 0.35 * math.sqrt(max(r.size_x * r.size_y, 1e-12)):
                    break
            else:
                kept[b].append(r)
    assert {(r.block_id, r.id) for r in layouts.suppressed(spark, folder).collect()} == {(b, r.slot_id) for b, rows in kept.items() for r in rows}


def test_sites_are_on_blocks(spark, folder):
    from pyspark.sql import functions as F

    from blockloom.operators import grid
    from blockloom.plans import spatials

    blocks = spatials.blocks(spark, folder).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry"))
    cells = {(r.block_id, r.gi, r.gj) for r in grid.clipped_cells(blocks, 15.0).collect()}
    sites = layouts.service_sites(spark, folder).collect()
    assert sites and len({s.zone for s in sites}) > 4
    for s in sites:
        assert all((s.zone, s.row_i + i, s.col_j + j) in cells for i in range(s.height) for j in range(s.width))
