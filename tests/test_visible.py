"""Visible pages against all pairs, and what the join meets."""

import random

from quirework.operators import layout

PAGE = "doc_id long, page_id long, page_idx long, height double"
VIEW = "doc_id long, view long, scroll_x double, scroll_y double, zoom double, page_spacing int, screen_width int, screen_height int"


def test_visible_pages_equal_all_pairs(spark):
    rng = random.Random(13)
    pages = [(d, d * 1000 + i, i, rng.choice([300.0, 792.0, 800.0, 5.0]) if d % 2 else 792.0) for d in range(6) for i in range(rng.choice([1, 40, 300]))]
    views = [(d, d * 100 + k, 0.0, rng.uniform(-2000, 250_000), rng.choice([0.1, 0.5, 1.0, 3.0]), rng.choice([0, 20, 70]), 800, rng.choice([0, 600, 2000])) for d in range(7) for k in range(30)]
    got = {(r["view"], r["page_id"]) for r in layout.visible_pages(spark.createDataFrame(pages, PAGE), spark.createDataFrame(views, VIEW)).collect()}
    want = set()
    for d, view, _, y, zoom, spacing, _, screen in views:
        low, high = y / zoom, (screen + y) / zoom
        for e, page, i, h in pages:
            top = i * (h + spacing / zoom)
            if e == d and top + h >= low and top <= high:
                want.add((view, page))
    assert got == want and len(got) > 50


def test_many_viewports_of_a_long_document_do_not_meet_all_its_pages(spark):
    n, views = 4000, 200
    pages = spark.createDataFrame([(1, i, i, 792.0 + i % 3) for i in range(n)], PAGE)
    seen = spark.createDataFrame([(1, k, 0.0, k * 15_000.0, 1.0, 20, 800, 600) for k in range(views)], VIEW)
    assert views <= layout.visible_pages(pages, seen).count() < 3 * views
    assert layout.near_pages(pages, seen).count() <= 3 * layout.BIN * views < n * views // 80
