"""Quality rules, line dedup, the n-gram join and the mix: defined cases, and brute force on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoledger.llm import jaccard, lines, mixing, quality
from geoledger.llm.components import _large, _small, components

LINE = "a line that is long enough to count as boilerplate text"


def repeat_words(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


class TestQuality:
    def test_features_against_brute_force(self, docs):
        rng = random.Random(3)
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
        texts += [None, "", " \n\t ", "one", "é # x\n\né # x\n", "a b c d e f a b c d e", "w " * 3000]
        got = {r.doc_id: r for r in quality.judged(docs([(i, t, "s") for i, t in enumerate(texts)]), [quality.FEW_WORDS, quality.REPEATED]).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            words = (text or "").split()
            kept = [x for x in (text or "").split("\n") if x.strip()]
            row = got[i]
            assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
            assert row.n_repeat_words == repeat_words(words)
            assert row.n_dup_lines == len(kept) - len(set(kept))
            assert row.base_failed == (len(words) < 10 or 100 * row.n_repeat_words > 20 * len(words))
            assert not (row.kept and row.base_failed)

    def test_order_does_not_change_the_verdict(self, docs):
        frame = docs([(0, "good words only in this plain text of more than ten words", "s"), (1, "SHOUT!! " * 30, "s"), (2, None, "s"), (3, "### a " * 40, "s")])
        for rules in (quality.RULES, quality.RULES[::-1]):
            kept = frame.filter(quality.verdict(rules, F.col("text")).isNull()).select("doc_id").collect()
            assert [r.doc_id for r in kept] == [0]

    def test_best_rejection_per_cost_first(self):
        a, b, c = quality.RULES[:3]
        found = [quality.Estimate(a, 1.0, 0.5), quality.Estimate(b, 0.1, 0.2), quality.Estimate(c, 0.1, 0.0)]
        assert quality.ordered(found) == [b, a, c]

    def test_keeps_columns_and_empty_tables(self, docs):
        frame = docs([(0, "good words only in this plain text of more than ten words", "s")] * 2, extra=["n_words", "kept"])
        kept = quality.keep_good(frame)
        assert kept.columns == frame.columns and kept.count() == 2
        assert quality.keep_good(frame.limit(0)).count() == 0
        assert quality.judged(frame.limit(0), [quality.FEW_WORDS]).count() == 0


class TestLines:
    def brute(self, rows, min_chars=40, min_docs=5):
        held = {}
        for n, (i, t, _) in enumerate(rows):
            for line in (t or "").split("\n"):
                key = line.strip(" \t\n\x0b\x0c\r")
                key = "".join(c.lower() if c.isascii() else c for c in key)
                if len(key) >= min_chars:
                    held.setdefault(key, set()).add((n, -1 if i is None else i))
        out = []
        for i, t, _ in rows:
            kept = []
            for line in (t or "").split("\n"):
                key = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
                found = held.get(key, ())
                if len(found) < min_docs or max(x for _, x in found) == (-1 if i is None else i):
                    kept.append(line)
            out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
        return sorted(out, key=str)

    @pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
    def test_against_brute_force(self, docs, batches, fanout):
        rng = random.Random(batches)
        pool = [f"{LINE} number {k}" for k in range(12)] + ["short", "", f"  {LINE.upper()} NUMBER 3\t", "É" * 40, "é" * 40]
        rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))), "s") for i in range(40)]
        rows += [(3, f"{LINE} number 3\nagain", "s"), (None, f"{LINE} number 3", "s"), (50, None, "s"), (51, "", "s"), (39, rows[39][1], "s")]
        out, total, dropped = lines.dedup_lines(docs(rows), batches=batches, fanout=fanout)
        got = [(r.doc_id, r.text or "", r[total], r[dropped]) for r in out.collect()]
        assert sorted(got, key=str) == self.brute(rows)

    def test_clashing_columns_and_empty_table(self, docs):
        frame = docs([(i, LINE, "s") for i in range(6)], extra=["gone", "at", "h1", "batch", "gone_lines"])
        out, total, dropped = lines.dedup_lines(frame)
        assert out.columns[:-2] == frame.columns and out.columns[-2:] == [total, dropped]
        assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, "") for i in range(5)] + [(5, LINE)]
        out, _, _ = lines.dedup_lines(frame.limit(0))
        assert out.count() == 0

    def test_runs_are_compacted(self, spark):
        runs = lines.LineRuns(fanout=2)
        for b in range(5):
            runs.add(spark.createDataFrame([(1, 1, 10 - b), (2, b, 10 - b)], "h1 long, h2 long, doc_id long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        assert {tuple(r)[:4] for r in runs.compacted().collect()} == {(1, 1, 5, 10)} | {(2, b, 1, 10 - b) for b in range(5)}


class TestJaccard:
    def brute(self, rows):
        sets = []
        for i, t, _ in rows:
            w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
            sets.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
        parent = {i: i for i, _ in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = Counter()
        for x, (i, a) in enumerate(sets):
            for y, (j, b) in enumerate(sets):
                if x != y and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    links[x] += 1
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
        return sorted((i, len(s), root(i), links[x]) for x, (i, s) in enumerate(sets))

    def rows(self, rng, families=12, members=9, words=60):
        rows = []
        for _ in range(families):
            base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, words))]
            for _ in range(members):
                copy = list(base)
                for _ in range(rng.randrange(0, 4)):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
                rows.append((rng.randrange(10**6), " ".join(copy), "s"))
        return list({r[0]: r for r in rows}.values())

    def got(self, frame):
        return sorted(tuple(r) for r in jaccard.classes(frame).collect())

    @pytest.mark.parametrize("seed", [1, 2])
    def test_against_brute_force(self, docs, seed):
        rows = self.rows(random.Random(seed))
        rows += [(10**6 + 1, "", "s"), (10**6 + 2, None, "s"), (10**6 + 3, "A b", "s"), (10**6 + 4, "a B ", "s"), (10**6 + 5, "a b c", "s"),
                 (10**6 + 6, "long " * 30000, "s"), (10**6 + 7, "LONG " * 400, "s")]
        assert self.got(docs(rows)) == self.brute(rows)

    def test_heavy_columns_and_tiles(self, docs, monkeypatch):
        monkeypatch.setattr(jaccard, "LIGHT", 3)
        monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
        rng = random.Random(5)
        base = [f"w{k}" for k in range(80)]
        rows = []
        for i in range(70):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(80)] = f"x{rng.randrange(1000)}"
            rows.append((i, " ".join(copy[:rng.choice([80, 80, 40])]), "s"))
        assert self.got(docs(rows)) == self.brute(rows)

    def test_links_where_a_tile_is_empty(self, docs, monkeypatch):
        monkeypatch.setattr(jaccard, "TILE_GRAMS", 40)
        rng = random.Random(7)
        rows = []
        for family in range(20):
            base = [f"f{family}w{k}" for k in range(60)]
            rows += [(2 * family, " ".join(base), "s"), (2 * family + 1, " ".join([*base, f"x{rng.randrange(1000)}"]), "s")]
        got = self.got(docs(rows))
        assert {links for *_, links in got} == {1} and got == self.brute(rows)

    def test_frequent_grams_only_change_the_order(self, docs, monkeypatch):
        monkeypatch.setattr(jaccard._frequent, "__defaults__", (1, 2))
        rows = self.rows(random.Random(7), families=6)
        assert self.got(docs(rows)) == self.brute(rows)

    def test_shared_and_null_ids_and_empty_table(self, docs):
        text = "one two three four five six seven"
        rows = [(4, text, "s"), (4, text, "s"), (None, text, "s"), (7, text, "s"), (7, "other words that link with nothing else at all", "s")]
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs(rows)).collect()}
        assert got == {(4, 3, 4), (None, 3, None), (7, 3, 4), (7, 5, 4)}
        assert jaccard.classes(docs(rows).limit(0)).count() == 0
        kept = jaccard.one_of_each(docs(rows, extra=["number", "_go", "component_id"]))
        assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 4), (True, None)]

    def test_a_round_of_components_takes_three_shuffles(self, spark, capsys):
        edges = spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")
        _small(_large(edges)).distinct().explain()
        assert capsys.readouterr().out.count("Exchange") == 3

    def test_components_of_a_long_path(self, spark):
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (101, 102), (102, 101)], "a long, b long")
        got = {tuple(r) for r in components(edges).collect()}
        assert got == {(i, 0) for i in range(61)} | {(101, 101), (102, 101)}


class TestMix:
    def targets(self, sizes):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, full = sum(sizes.values()), set()
        while True:
            free = [s for s in order if s not in full]
            unit = (total - sum(3 * sizes[s] for s in full)) / (sum(weight[s] for s in free) or 1)
            above = {s for s in free if unit * weight[s] > 3 * sizes[s]}
            if not above:
                return {s: 3.0 * sizes[s] if s in full else unit * weight[s] for s in order}
            full |= above

    def rows(self):
        rng = random.Random(11)
        rows = []
        for i in range(400):
            s = rng.choice(["a", "a", "a", "b", "c", "é", "", None, "tiny"][: 9 if i % 40 == 0 else 8])
            rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), s))
        return [*rows, (1000, None, "b"), *[(2000, "same words in a row", "c")] * 30, (None, "no id", "a"), (3000, "w " * 20, "solo")]

    def test_targets_and_taken(self, docs):
        rows = self.rows()
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        want = self.targets(sizes)
        got = mixing.mix(docs(rows)).collect()
        assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(i), len((t or "").split()), str(s)) for i, t, s in rows)
        taken = Counter()
        for r in got:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
            assert 0 <= r.copies <= 3
            taken[r.source] += r.copies * r.size
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(len((t or "").split()) for _, t, x in rows if x == s) / 2 + 1e-6

    def test_reruns_agree(self, docs):
        rows = self.rows()
        one = sorted(map(str, mixing.mix(docs(rows)).collect()))
        rng = random.Random(1)
        rng.shuffle(rows)
        assert one == sorted(map(str, mixing.mix(docs(rows).repartition(7)).collect()))

    def test_expectations_stay(self, spark):
        items = spark.range(400).selectExpr("'s' AS source", "id", "1L AS k", "10L AS a", "2.5D AS m")
        chosen = Counter()
        for seed in range(8):
            got = [r.id for r in mixing.round_dependently(items, seed).collect() if r.up]
            assert len(got) == 100
            chosen.update(got)
        assert 250 <= len(chosen) <= 390

    def test_columns_and_empty_table(self, docs):
        frame = docs(self.rows(), extra=["size", "copies", "_c", "k"])
        out = mixing.mixed(frame)
        assert out.columns == [*frame.columns, "copies_"]
        taken = mixing.mix(frame).filter("copies > 0")
        assert out.count() == taken.count() and out.agg(F.sum("copies_")).first()[0] == taken.agg(F.sum("copies")).first()[0]
        assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0
