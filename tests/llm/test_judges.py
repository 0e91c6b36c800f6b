import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import quality_model, quality_rules, toxicity, url_filter
from terravane.llm.queries import URL_RULES
from tests.llm.cases import LONG, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_repetition(text, least=5):
    w = WORD.findall(text or "")
    n = len(w)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = {i + k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    inside = {i + k for i in range(n) if best[i] >= least for k in range(best[i])}
    longest = max(best, default=0)
    return [n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(again), len(inside), longest if longest >= least else 0]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é|\n\t#日", max_size=60)), max_size=5))
def test_repetition_counts(texts):
    found = quality_rules.repetition_columns(pa.array(texts, pa.string()), quality_rules.RepetitionLimits())
    for i, t in enumerate(texts):
        assert [int(found[c][i]) for c in COUNTS] == brute_repetition(t)


def test_spans_and_slices():
    text = "x1 a b c d e f x2 a b c d e f x3 x4"
    assert quality_rules.repeated_spans(text) == [(1, 7), (8, 14)]
    array = pa.array(["skip me", text, None]).slice(1)
    found = quality_rules.repetition_columns(array, quality_rules.RepetitionLimits())
    assert found["n_words"].tolist() == [16, 0] and found["covered_words"].tolist() == [12, 0] and found["longest_repeat"].tolist() == [6, 0]


def test_rule_verdicts(spark):
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    loop = clean + " " + clean
    docs = documents(spark, [(500, clean, "en", "s", 1), (501, loop, "en", "s", 1), (502, clean + "\n" + clean[:200], "en", "s", 1)])
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert out[500]["kept"] and not out[501]["kept"] and out[502]["kept"]
    assert out[100]["base_failed"] and out[101]["base_failed"] and not out[103]["kept"]
    assert out[103]["n_words"] == len(LONG.split()) and quality_rules.quality_rules(docs).count() == docs.count()
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    clash = quality_rules.quality_rules(docs.withColumns({"kept": F.lit(7), "n_words": F.lit("x")}))
    assert clash.where("kept = 7 and n_words = 'x'").count() == docs.count() and clash.where("kept_").count() == sum(r["kept"] for r in quality_rules.quality_rules(docs).collect())


def test_each_repetition_limit_rejects_alone():
    """Documents of 1,000 words that pass the base rule: by passages given twice."""

    def doc(*passages):
        twice = [[f"p{i}x{j}" for j in range(n)] for i, n in enumerate(passages)]
        once = [f"u{j}" for j in range(1000 - 2 * sum(passages))]
        step = len(once) // (2 * len(passages))
        parts = [w for k, p in enumerate(twice + twice) for w in once[k * step : (k + 1) * step] + p]
        return " ".join(parts + once[2 * len(passages) * step :])

    texts = [doc(240), doc(140), doc(*[10] * 20), doc(120), doc(10)]
    found = quality_rules.repetition_columns(pa.array(texts), quality_rules.RepetitionLimits())
    assert found["n_words"].tolist() == [1000] * 5 and not found["base_failed"].any()
    assert found["covered_words"].tolist() == [480, 280, 400, 240, 20] and found["longest_repeat"].tolist() == [240, 140, 10, 120, 10]
    assert found["kept"].tolist() == [False, False, False, True, True]
    off = [quality_rules.repetition_columns(pa.array(texts), quality_rules.RepetitionLimits(**k))["kept"].tolist() for k in ({"longest": 1.0}, {"covered": 1.0})]
    assert off == [[False, True, False, True, True], [False, False, True, True, True]]


# toxicity


def toxic_world(seed=0, n=600):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(10, 60))]
        bad = int(rng.random() < 0.2)
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "zorgling", "vexnard"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, bad))
    return docs, labels


def test_toxicity_is_learned_and_holds_out(spark):
    rows, marks = toxic_world()
    docs = documents(spark, [(10_000 + r[0], *r[1:]) for r in rows])
    labels = spark.createDataFrame([(10_000 + i, q, t) for i, q, t in marks] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert "zorgle" in model.words and all(w.startswith(("zor", "vex")) for w in model.words)
    out = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out()).collect()
    truth = {10_000 + i: t for i, _, t in marks}
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held"] and r["doc_id"] in truth]
    assert len(judged) > 80 and sum(p == t for p, t in judged) / len(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == docs.count()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)


def test_toxicity_without_examples(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, none)
    assert toxicity.score_toxicity(docs, model).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    clash = toxicity.score_toxicity(docs.withColumns({"score": F.lit(7), "predicted": F.lit(8)}), model)
    assert clash.columns[-4:] == ["score", "predicted", "score_", "predicted_"] and clash.where("score = 7 and predicted_ = 0").count() == docs.count()


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, marks = toxic_world(1, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    a, b = (toxicity.train_toxicity(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int")) for m in (marks, flipped))
    assert a == b


def test_grammar_finds_clauses():
    s = toxicity.ClauseScorer({"fool": 4.0, "idiot": 3.0}, {})
    insult, aimed, threat, negated, reported = range(5)

    def kinds(text):
        return [{k: w for k, w in enumerate(c) if w} for c in s.clauses(text)]

    assert kinds("you are a fool.") == [{aimed: 4.0}] and kinds("a fool") == [{insult: 4.0}] and kinds("such a fool.") == [{insult: 6.0}]
    assert kinds("not a fool.") == [{negated: 4.0}] and kinds('they wrote: "fool"') == [{reported: 4.0}]
    assert kinds("the word idiot appears here") == []
    assert kinds("I will kill you. fine weather") == [{threat: 3.0}] and kinds("he is killing them") == [{threat: 3.0}] and kinds("do not kill her") == [{negated: 3.0}]
    for harmless in ("kill the lights", "kill the process", "do not kill the process", "the manual said kill the process", "they never beat the market", ""):
        assert kinds(harmless) == []
    assert kinds("a fool; a fool") == [{insult: 4.0}] * 2 and kinds("not the word. fool") == [{insult: 4.0}]  # states end with their clause
    marked, plain = kinds('a 5" pipe. you idiot. you are an idiot'), kinds("a 5 pipe. you idiot. you are an idiot")
    assert marked == plain == [{aimed: 3.0}] * 2


def by_rules(symbols):
    """(place, kind, weight) of matches, from the rules as they are told, clause by clause and with the whole clause in sight."""
    t = toxicity
    out, begin = [], 0
    for end in [i for i, s in enumerate(symbols) if s == t.END] + [len(symbols)]:
        clause = symbols[begin:end]
        kind, weight, spent = {}, {}, set()
        for i, s in enumerate(clause):
            if s == t.INSULT and not (i and clause[i - 1] == t.MENTION):
                kind[i], weight[i] = t.INSULTED, 1.0
                if i and clause[i - 1] == t.INSULT and (i - 1) in kind:
                    weight[i] = 1.25
                elif i and (clause[i - 1] == t.INTENSE or (i > 1 and clause[i - 2] == t.INTENSE and clause[i - 1] not in (t.MENTION, t.INSULT))):
                    weight[i] = 1.5
        for i, s in enumerate(clause):
            if s == t.TARGET:
                verbs = [j for j in range(max(0, i - 3), i) if clause[j] == t.THREAT and j not in spent]
                if verbs:
                    kind[i], weight[i] = t.THREATENED, 1.0
                    spent.update(j for j in range(i) if clause[j] == t.THREAT)
        for i in kind:
            if kind[i] == t.INSULTED and t.TARGET in clause[:i]:
                kind[i] = t.AIMED
        for i in kind:
            if t.NEGATION in clause[max(0, i - 3) : i]:
                kind[i] = t.NEGATED
        quoted, said = False, False
        for i, s in enumerate(clause):
            if s == t.QUOTE and not said:
                quoted = not quoted
            if s == t.REPORT and not quoted:
                said = True
            if i in kind and (quoted or said):
                kind[i] = t.REPORTED
        out += [(begin + i, kind[i], weight[i]) for i in sorted(kind)]
        begin = end + 1
    return out


def test_machine_follows_the_rules():
    rng = random.Random(0)
    machine = toxicity.grammar()
    for _ in range(3000):
        symbols, state, got = [rng.randrange(10) for _ in range(rng.randrange(1, 14))], machine.start, []
        for i, symbol in enumerate(symbols):
            state, out, weight = machine.step(state, symbol)
            if out in toxicity.MATCHES:
                got.append((i, out, weight))
        assert got == by_rules(symbols), symbols


def test_composition_is_the_sequence():
    rng = random.Random(0)
    parts = [toxicity.insult(), toxicity.threat(), toxicity.target(), toxicity.negation(), toxicity.reported_speech()]
    both = toxicity.grammar()
    for _ in range(200):
        states, state, symbols = [p.start for p in parts], both.start, [rng.randrange(10) for _ in range(12)]
        for symbol in symbols:
            state, out, weight = both.step(state, symbol)
            chain, w = symbol, 1.0
            for i, p in enumerate(parts):
                states[i], chain, x = p.step(states[i], chain)
                w *= x
            assert (out, weight) == (chain, pytest.approx(w))


def test_document_scores_by_hand(spark):
    model = toxicity.ToxicityModel({"fool": 4.0}, {"idio": 2.0}, (-2.0, 0.7, 0.3, 0.1, 0.2, 0.4, 0.6, -0.5, -0.4))
    texts = ["you fool. such an idiotic fool fool; I did not kill you", "he said: fool! they will attack you\nthe word fool", "fine weather", "", None]
    names = [(toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTING), (toxicity.THREAT, toxicity.THREATS), (toxicity.INTENSE, toxicity.INTENSIFIERS), (toxicity.MENTION, toxicity.MENTIONS)]
    want = []
    for text in texts:
        words = re.findall(r"[^\W\d_]+|[.!?;:\n]", (text or "").lower())
        weigh = {"fool": 4.0, "idiotic": 2.0}
        symbols = [toxicity.INSULT if w in weigh else toxicity.END if not w.isalpha() else next((s for s, known in names if w in known), toxicity.OTHER) for w in words]
        clauses, totals = {}, [0.0] * 5
        for i, kind, factor in by_rules(symbols):
            value = factor * weigh.get(words[i], toxicity.THREAT_WEIGHT)
            totals[kind - toxicity.INSULTED] += value
            clause = symbols[:i].count(toxicity.END)
            clauses[clause] = clauses.get(clause, 0.0) + value * toxicity.PRIOR[kind - toxicity.INSULTED]
        logs = [np.log(1 + t) for t in totals]
        x = [sum(p * v for p, v in zip(toxicity.PRIOR, logs, strict=True)), np.log(1 + max(clauses.values(), default=0)), np.log(1 + len(clauses)), *logs]
        want.append(1 / (1 + np.exp(-(model.curve[0] + sum(w * v for w, v in zip(model.curve[1:], x, strict=True))))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["score"] for r in toxicity.score_toxicity(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(want) and got[0] > got[1] > got[2]


# graded quality


def test_ordinal_model(spark):
    rng = random.Random(3)
    good = ["alpha", "beta", "gamma", "delta"]
    rows, labels = [], []
    for i in range(900):
        g = rng.randrange(3)
        words = [rng.choice(good) + str(rng.randrange(50)) for _ in range(30)]
        words = [w + "%%%" if rng.random() < (2 - g) * 0.45 else w for w in words]
        rows.append((10_000 + i, " ".join(words), "en", "s", 1))
        labels.append((10_000 + i, int(g > 0), int(g == 1)))
    docs = documents(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train_quality(docs, lab, quality_model.graded(), bound=600)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in quality_model.grade_documents(docs, model).collect()}
    grade = {i: 2 * q - t for i, q, t in labels}
    by = [np.mean([out[i]["expected_grade"] for i in grade if grade[i] == g]) for g in range(3)]
    assert by[0] < by[1] < by[2]
    assert np.mean([out[i]["kept"] == (grade[i] > 0) for i in grade]) > 0.9
    assert not out[100]["kept"] and not out[101]["kept"]
    assert quality_model.grade_documents(empty(spark), model).count() == 0
    assert quality_model.grade_documents(docs.withColumn("kept", F.lit(1)), model).columns[-2:] == ["tail_probability", "kept_"]


def features_by_hand(text):
    """Bucket -> value, from the definition: one word and one letter at a time."""
    mask, base, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def spread(x):
        x ^= x >> 30
        x = x * a & mask
        x ^= x >> 27
        x = x * b & mask
        return x ^ x >> 31

    def code(data):
        return spread((sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(data)) + len(data) * b) & mask)

    def kind(c):
        return 1 if c >= 0x80 or 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c

    counts, last = [Counter(), Counter()], None
    for word in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()):
        kinds = [kind(c) for c in word]
        shape = bytes(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])
        counts[0][code(word) % 4096] += 1
        counts[1][4096 + spread((code(shape) * a + (word == last)) & mask) % 1024] += 1
        last = word
    out = {}
    for half in counts:
        value = {k: np.log(1 + n) for k, n in half.items()}
        length = sum(v * v for v in value.values()) ** 0.5
        out |= {k: v / length for k, v in value.items()}
    return out


def test_grades_by_hand(spark):
    rng = np.random.default_rng(4)
    model = quality_model.OrdinalModel(rng.normal(size=quality_model.BUCKETS), np.array([-0.4, 0.3, 0.9]))
    docs = documents(spark)
    for r in quality_model.grade_documents(docs, model, tail=2).where("length(text) < 2000 or text is null").collect():
        x = sum(model.weights[k] * v for k, v in features_by_hand(r["text"]).items())
        tails = [1 / (1 + np.exp(-(x - t))) for t in model.thresholds]
        assert r["expected_grade"] == pytest.approx(sum(tails)) and r["tail_probability"] == pytest.approx(tails[1])
        assert r["kept"] == (tails[1] >= 0.5 and bool((r["text"] or "").strip()))


def test_ordinal_gradient_is_right():
    rng = np.random.default_rng(0)
    x = quality_model.Sparse(60, np.repeat(np.arange(60), 3), rng.integers(0, 6, 180), rng.random(180))
    grades = rng.integers(0, 4, 60)
    model = quality_model.fit_ordinal(x, grades, 4, rounds=3000, rate=0.05, l2=0.0)

    def loss(w, t):
        tail = 1 / (1 + np.exp(-(x.dot(w)[:, None] - t)))
        full = np.column_stack([np.ones(60), tail, np.zeros(60)])
        return -np.log(full[np.arange(60), grades] - full[np.arange(60), grades + 1]).mean()

    best = loss(model.weights, model.thresholds)
    for k in range(6):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += d
            assert loss(w, model.thresholds) >= best - 1e-4
    for k in range(3):
        for d in (-0.05, 0.05):
            t = model.thresholds.copy()
            t[k] += d
            assert loss(model.weights, t) >= best - 1e-4


def test_no_labels_at_all(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_model.train_quality(documents(spark), none, quality_model.graded())
    assert quality_model.grade_documents(documents(spark), model).count() == documents(spark).count()


# urls


def by_hand(url):
    found = re.match("(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), found.group(1)), found.group(2)) if found else ("", "")
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def score_by_hand(model, host, path):
    grams = Counter()
    for salt, text in (("h", "^" + host + "$"), ("p", "^" + path + "$")):
        for n in (3, 4, 5):
            grams.update(zlib.crc32((salt + g).encode()) % len(model.weights) for g in ([text[i : i + n] for i in range(len(text) - n + 1)] or [text]))
    value = {g: np.log(1 + c) for g, c in grams.items()}
    length = sum(v * v for v in value.values()) ** 0.5
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights[g] * v for g, v in value.items()) / length)))


URLS = ["https://long.example/" + "abc/" * 50_000, "http://A.Example.COM/fr/1?x=/de/#y", "https://example.org/es/9", "https://sub.example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/1", "http://x.com/de/", "http://org/", "http://x.org", "ftp://h?q/p", "no scheme/fr/", "", None, "a://b://c/d", "http://İ.com/fr/x", "http:///path", "http://h#/frag", "http://x.com/de\n/fr/"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(99, URLS[0])], "page_id long, url string").withColumn("html", F.lit("x"))
    model = url_filter.train_url_model()
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages, URL_RULES, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = by_hand(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule and rule.text)
        score = None if rule else score_by_hand(model, host, path)
        assert out[i]["score"] == (score and pytest.approx(score)) and out[i]["verdict"] == (rule.verdict if rule else "block" if score >= 0.5 else "allow")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, URL_RULES, model).count() == 0
    clash = url_filter.judge_urls(pages.withColumns({"host": F.lit(1), "verdict": F.lit("x")}), URL_RULES, model)
    assert {r["page_id"]: (r["host"], r["verdict"], r["host_"], r["verdict_"]) for r in clash.collect()} == {i: (1, "x", r["host"], r["verdict"]) for i, r in out.items()}


def test_url_model_fits_and_generalises():
    model = url_filter.train_url_model()
    assert all((model.score(*url_filter.split_url(u)) >= 0.5) == bool(y) for u, y in url_filter.LABELLED_URLS)
    hits = 0
    for k in range(6):
        held = url_filter.LABELLED_URLS[k::6]
        rest = [r for i, r in enumerate(url_filter.LABELLED_URLS) if i % 6 != k]
        part = url_filter.train_url_model(rest)
        hits += sum((part.score(*url_filter.split_url(u)) >= 0.5) == bool(y) for u, y in held)
    assert hits / len(url_filter.LABELLED_URLS) > 0.6
    assert url_filter.train_url_model([]).score("a", "b") == 0.5
