"""Recall at 20 of op8's search against brute force, over a whole table of embeddings.

python tests/llm/measure_recall.py /root/testdata/check_l [rounds]

rounds: so many rounds of NN-descent instead of until it settles (0: the starting graph alone). Prints one JSON line.
"""

import json
import os
import sys
import time

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


def recall(rows: dict[int, list], found: dict[int, set], k: int = 20) -> float:
    """Share of the true k nearest of each query that were found; rows: vectors by id."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    hits = total = 0
    for q in sorted(found):
        sims = x @ np.array(rows[q], np.float64)
        sims[np.searchsorted(ids, q)] = -np.inf
        best = np.lexsort((ids, -sims))[:k]
        hits += len(found[q] & set(ids[best].tolist()))
        total += len(best)
    return hits / max(1, total)


def main(folder: str, rounds: int | None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quirework.llm import neighbours

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "12").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    began = time.time()
    found: dict[int, set] = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, rounds=rounds).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    took = time.time() - began
    valid = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    rows = {r["vec_id"]: r["embedding"] for r in table.collect() if valid(r["embedding"])}
    print(json.dumps({"table": folder, "vectors": len(rows), "queries": len(found), "rounds": rounds, "recall_at_20": round(recall(rows, found), 4), "seconds": round(took, 1)}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else None)
