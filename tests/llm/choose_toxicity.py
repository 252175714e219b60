"""Choose the toxicity machine's cost and ratio inside the learning rows: folds crc32(doc_id) mod 5 in 1..4, each held out once.

    python -m tests.llm.choose_toxicity /root/testdata/sf0.1

Rows of remainder 0 are read by no fold. Prints a line per setting: recall, false alarms and accuracy over the four folds.
"""

import sys
import zlib
from concurrent.futures import ProcessPoolExecutor
from itertools import product

import pandas as pd

from ledgerlight.llm import toxicity

COSTS = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1)
RATIOS = (3, 10, 30)


def learning_rows(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).dropna(subset="doc_id")
    labels = pd.read_parquet(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).dropna()
    marks = labels.groupby("doc_id")["toxic"].max()
    rows = docs[docs["doc_id"].isin(marks.index)]
    fold = rows["doc_id"].map(lambda i: zlib.crc32(str(int(i)).encode()) % 5)
    rows, fold = rows[fold > 0], fold[fold > 0]
    bags = [sorted({toxicity.unit_of(w) for w in toxicity.words_of(t)}) for t in rows["text"]]
    return bags, rows["doc_id"].map(marks).astype(int).tolist(), fold.tolist()


def tried(job):
    bags, marks, folds, fold, cost, ratio = job
    toxicity._svm.__defaults__ = (cost,)
    toxicity.RATIO = ratio
    scorer = toxicity.train([(b, y) for b, y, f in zip(bags, marks, folds, strict=True) if f != fold])
    out = {"tp": 0, "fn": 0, "fp": 0, "tn": 0}
    for bag, y, f in zip(bags, marks, folds, strict=True):
        if f == fold:
            hit = scorer.probability(max(scorer.margins(bag).tolist(), default=-toxicity.RANGE)) >= 0.5
            out[("tp" if hit else "fn") if y else ("fp" if hit else "tn")] += 1
    return cost, ratio, out


def main(folder):
    bags, marks, folds = learning_rows(folder)
    jobs = [(bags, marks, folds, fold, cost, ratio) for cost, ratio in product(COSTS, RATIOS) for fold in range(1, 5)]
    total = {}
    with ProcessPoolExecutor(8) as pool:
        for cost, ratio, found in pool.map(tried, jobs):
            own = total.setdefault((cost, ratio), dict.fromkeys(found, 0))
            for k, n in found.items():
                own[k] += n
    print("cost ratio recall false_alarms accuracy")
    for (cost, ratio), t in total.items():
        n = sum(t.values())
        print(f"{cost} {ratio} {t['tp'] / max(1, t['tp'] + t['fn']):.3f} {t['fp'] / max(1, t['fp'] + t['tn']):.4f} {(t['tp'] + t['tn']) / n:.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
