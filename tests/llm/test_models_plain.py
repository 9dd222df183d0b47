"""The two classifiers fitted and applied from their definitions, on dense tables by Newton's method."""

import subprocess
import sys
import textwrap

import numpy as np

from lurewatch.llm import quality, textmodel, toxicity
from tests.llm.test_models import corpus


def features(texts):
    return [set(textmodel.Features().of(t or "").tolist()) for t in texts]


def told(rows, target, used):
    """Columns of features seen often enough and standing out, with their scales."""
    seen = {}
    for r in rows:
        for f in r:
            seen[f] = seen.get(f, 0) + 1
    least = min(textmodel.LEAST_DOCUMENTS, max(1, len(rows)))
    mean = sum(target[used]) / max(1, used.sum())
    spread = np.sqrt(sum((target[used] - mean) ** 2) / max(1, used.sum())) or 1.0
    kept = []
    for f in sorted(f for f, n in seen.items() if n >= least):
        own = [i for i, r in enumerate(rows) if f in r and used[i]]
        score = abs(sum(target[i] - mean for i in own)) / np.sqrt(max(1, len(own))) / spread
        if score >= textmodel.LEAST_SCORE:
            kept.append((f, score / 10))
    return kept


def table(rows, kept):
    return np.array([[scale if f in r else 0.0 for f, scale in kept] for r in rows]).reshape(len(rows), len(kept))


def newton(loss, point, rounds=200):
    """Minimum by Newton steps with differences of the gradient."""
    value, gradient = loss(point)
    for _ in range(rounds):
        hessian = np.array([(loss(point + h)[1] - gradient) / 1e-5 for h in np.eye(len(point)) * 1e-5])
        step = np.linalg.solve((hessian + hessian.T) / 2 + 1e-9 * np.eye(len(point)), gradient)
        size = 1.0
        while size > 1e-8 and loss(point - size * step)[0] > value:
            size /= 2
        point = point - size * step
        new, gradient = loss(point)
        if value - new < 1e-13:
            break
        value = new
    return point


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def logistic(rows, truth, earlier, used):
    kept = told(rows, truth, used)
    x = np.column_stack([table(rows, kept), earlier])

    def loss(w):
        z = x[used] @ w[:-1] + w[-1]
        y = truth[used]
        residual = sigmoid(z) - y
        return (np.logaddexp(0, z) - y * z).sum() + toxicity.PENALTY / 2 * w[:-1] @ w[:-1], np.append(
            x[used].T @ residual + toxicity.PENALTY * w[:-1], residual.sum())

    w = newton(loss, np.append(np.zeros(x.shape[1]), np.log(truth[used].mean() / (1 - truth[used].mean()))))
    return lambda new, before: sigmoid(np.column_stack([table(new, kept), before]) @ w[:-1] + w[-1])


def prepared(spark):
    docs, labels = corpus(240)
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    texts = {i: t for i, t, _ in docs}
    return frame, marks, texts, sorted(labels)


def test_chain_from_its_definition(spark):
    frame, marks, texts, labels = prepared(spark)
    rows, every = features([texts[i] for i, _, _ in labels]), features([texts[i] for i in sorted(texts)])
    fold, everybody = np.arange(len(rows)) % toxicity.FOLDS, np.ones(len(rows), bool)
    truths = [np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for _, _, t in labels])]
    earlier, before, wanted = np.empty((len(rows), 0)), np.empty((len(every), 0)), []
    for truth in truths:
        wanted.append(logistic(rows, truth, earlier, everybody)(every, before))
        unseen = np.zeros(len(rows))
        for k in range(toxicity.FOLDS):
            unseen[fold == k] = logistic(rows, truth, earlier, fold != k)(rows, earlier)[fold == k]
        earlier, before = np.column_stack([earlier, unseen]), np.column_stack([before, wanted[-1]])
    found = toxicity.judged(frame, marks).orderBy("doc_id").collect()
    for name, p in zip(("p_junk", "p_toxic"), wanted):
        assert np.abs(np.array([r[name] for r in found]) - p).max() < 5e-3
    assert [r["rejected"] for r in found] == [p >= toxicity.THRESHOLD for p in wanted[1]]


def test_ordinal_model_from_its_definition(spark):
    frame, marks, texts, labels = prepared(spark)
    rows, every = features([texts[i] for i, _, _ in labels]), features([texts[i] for i in sorted(texts)])
    grade = np.array([0 if q == 0 else 1 if t == 1 else 2 for _, q, t in labels])
    kept = told(rows, grade.astype(float), np.ones(len(rows), bool))
    x = table(rows, kept)

    def cuts(w):  # the second threshold lies above the first
        return np.array([w[-2], w[-2] + np.exp(w[-1])])

    def value(w):
        below = np.column_stack([np.zeros(len(x)), sigmoid(cuts(w)[None, :] - (x @ w[:-2])[:, None]), np.ones(len(x))])
        p = below[np.arange(len(x)), grade + 1] - below[np.arange(len(x)), grade]
        return -np.log(p).sum() + quality.PENALTY / 2 * w[:-2] @ w[:-2]

    def loss(w):
        steps = np.eye(len(w)) * 1e-6
        return value(w), np.array([(value(w + h) - value(w - h)) / 2e-6 for h in steps])

    model = quality.fit(textmodel.Sample([np.array(sorted(r)) for r in rows]), grade)
    found = {r["doc_id"]: r for r in quality.graded(frame, marks).collect()}
    # The fitted point is the minimum: its value is that of the definition's, and no coordinate step betters it.
    at = np.append([model.weights[f] / scale for f, scale in kept], [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    best, gradient = loss(at)
    assert np.abs(gradient).max() < 0.05 * max(1.0, best)
    better = newton(loss, at, rounds=3)
    scores, final = table(every, kept) @ better[:-2], cuts(better)
    tails = sigmoid(scores[:, None] - final[None, :])
    for i, own in zip(sorted(texts), tails):
        assert abs(found[i]["p_ge_1"] - own[0]) < 1e-2 and abs(found[i]["p_ge_2"] - own[1]) < 1e-2
        assert abs(found[i]["expected_grade"] - own.sum()) < 2e-2


def test_workers_need_no_package(tmp_path):
    """Runs in a process whose workers start where the package cannot be imported."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import importlib.util, os, sys
        os.chdir({str(tmp_path)!r})
        os.environ.pop("PYTHONPATH", None)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "2").getOrCreate()
        def lacks(batches):
            import importlib.util, pyarrow as pa
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(importlib.util.find_spec("lurewatch") is None)] * batch.num_rows)], names=["x"])
        assert spark.range(2).mapInArrow(lacks, "x long").agg(dict(x="min")).first()[0] == 1
        sys.path.insert(0, {sys.path[0]!r} if os.path.isdir({sys.path[0]!r} + "/lurewatch") else {str(__import__('pathlib').Path(__file__).parents[2])!r})
        from lurewatch.llm import neighbours, quality, toxicity
        docs = spark.createDataFrame([(i, "good words " * 5 + ("idiotic" if i % 2 else "fine")) for i in range(40)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
        assert toxicity.judged(docs, labels).count() == 40 and toxicity.judged(docs, labels).where("p_toxic > 0.5").count() == 20
        assert quality.graded(docs, labels).where("expected_grade > 0").count() == 40
        vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
        assert neighbours.nearest(vectors).count() == 40
        print("done")
        """))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]
