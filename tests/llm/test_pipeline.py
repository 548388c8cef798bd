"""The whole pipeline against plain Python on a small fixture."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from bidlens.llm import qualityrules, registry
from bidlens.llm.tables import ship
from tests.llm.test_llm import WORD, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)


def fixture_rows():
    rng = random.Random(11)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    clean = [[rng.choice(words) for _ in range(rng.randint(30, 60))] for _ in range(60)]
    rows = [(k, " ".join(w), "abc"[k % 3]) for k, w in enumerate(clean)]
    rows += [(100 + k, " ".join([*clean[k][:-1], "changed"]), "a") for k in range(12)]  # linked: one shingle differs
    rows += [(200 + k, " ".join([*clean[k][:15], "changed", *clean[k][16:]]), "b") for k in range(12, 18)]
    rows += [(300, rows[5][1], "c"), (301, rows[5][1], None), (302, None, "a"), (303, "", "b"), (304, "too short", "c")]
    rows += [(305, " ".join(["one two three four five"] * 8), "a"), (None, " ".join(rng.choice(words) for _ in range(40)), "b")]
    for k, source in enumerate("abc"):  # a value of three owners is an example
        rows.append((400 + k, " ".join(rng.choice(words) for _ in range(40)) + " password: exampleQ7", source))
    rows.append((410, "token=zQ8vLx2RmT5kWd " + " ".join(rng.choice(words) for _ in range(40)), "a"))
    rows.append((411, " ".join(rng.choice(words) for _ in range(40)) + " api_key = pT4mXw9ZrB6n é", "b"))
    return rows


def base_failed(text):
    w = WORD.findall(text or "")
    windows = defaultdict(list)
    for k in range(len(w) - 4):
        windows[tuple(w[k: k + 5])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    return len(w) < 10 or 100 * len(covered) > 20 * len(w)


def masked(rows):
    owners = defaultdict(set)
    for _, text, source in rows:
        for m in ASSIGN.finditer(text):
            owners[m[2]].add(source or "")
    return [(i, ASSIGN.sub(lambda m: m[0] if len(m[2]) < 6 or len(owners[m[2]]) >= 3 else "<assign>", t), s) for i, t, s in rows]


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    ship(spark)
    rows = fixture_rows()
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(305, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    verdict = {r.doc_id: r.kept for r in qualityrules.quality_rules(docs, labels).collect()}
    assert not any(verdict[i] for i, t, _ in rows if base_failed(t))
    left = [r for r in rows if verdict[r[0]]]
    assert len(left) >= len(rows) - 12
    comps = {i: c for i, _, c in brute_components(left, 80, 100, 5)}
    left = [r for r in left if r[0] is None or comps[r[0]] == r[0]]
    left = masked(left)
    assert {t.split()[0] for i, t, _ in left if i == 410} <= {"<assign>"}

    library = tokenizers.Tokenizer.from_file(registry.TOKENIZER)
    want = {}
    for i, t, _ in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_sha256) for r in got)
    times, size, longest, taken = Counter(r.doc_id for r in got), Counter(), Counter(), Counter()
    assert max(times.values()) <= 3
    for i, t, s in left:
        n = len(WORD.findall(t))
        size[s] += n
        longest[s] = max(longest[s], n)
        taken[s] += n * times[i]
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5)))
    target, open_ = {}, set(size)
    while open_:  # full sources leave their excess to the others
        rest = sum(size.values()) - sum(target.values())
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * size[s]}
        target |= {s: 3 * size[s] if full else level * weights[s] for s in full or open_}
        open_ -= full or open_
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
