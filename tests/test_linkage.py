"""Behaviour of the record-linkage operators on small frames."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge.config import LinkConfig, artifact_hash
from linkforge.functions import text
from linkforge import cli
from linkforge.operators import blocking, diagnosis, evaluation, features, fusion, model, sampling, submission, tfidf
from linkforge.plans import stages
from linkforge.sources import records
from linkforge.streaming import incremental

COLUMNS = "entity_id string, business_name string, business_address string, country string"


def frame(spark, rows):
    return records.normalize_records(spark.createDataFrame(rows, COLUMNS))


def pairs(df):
    return {(r.source1_entity_id, r.candidate_entity_id) for r in df.collect()}


def test_names(spark):
    rows = [("1", "  Société Générale S.A.S. ", "Plot 12/3, M.G. Road 560001", "France"), ("2", "ABC & Sons Private Limited", "", " Nouvelle-Zélande "), ("3", "Traders,   Sharma Pvt. Ltd.", "12b 184th", ""), ("4", "Limited", "", "")]
    out = {r.entity_id: r for r in frame(spark, rows).collect()}
    assert out["1"].name_full == out["1"].name_core == "societe generale s a s"
    assert out["1"].postcode == "560001" and {"12", "3"} <= set(out["1"].address_numeric_tokens)
    assert out["2"].name_full == "abc and sons private limited" and out["2"].name_core == out["2"].name_sorted == "abc and sons"
    assert out["2"].country_norm == "nouvelle-zélande" and out["2"].legal_form == "private limited"
    assert out["3"].name_core == "traders sharma" and out["3"].name_sorted == "sharma traders" and out["3"].address_numeric_tokens == ["12b"]
    assert out["4"].name_core == "limited" and out["4"].legal_form == "limited"


def test_cross_country_and_cap(spark):
    source = frame(spark, [("S1-1", "Maison Bleue", "", "France"), ("S1-2", "common name", "", "US")])
    feed = frame(spark, [("S2-1", "Maison Bleue", "", "Canada"), *((f"S2-{i}", f"common x{i}", "", "US") for i in range(2, 6))])
    found = blocking.generate_candidates(source, feed, LinkConfig())
    assert ("S1-1", "S2-1") in pairs(found.where("block_cross_country_exact_name = 1"))
    assert not pairs(blocking.generate_candidates(source, feed, LinkConfig(posting_cap=2))) & {("S1-2", f"S2-{i}") for i in range(2, 6)}
    scaled = LinkConfig(posting_cap=2, posting_cap_fraction=1.0, posting_cap_max=4)
    assert len([p for p in pairs(blocking.generate_candidates(source, feed, scaled)) if p[0] == "S1-2"]) == 4


def test_df_modes(spark):
    cases = [(80, 100_000, "absolute", True), (120, 100_000, "relative", False), (120, 1_000_000, "relative", True), (80, 100_000, "hybrid", True)]
    for df, shard, mode, want in cases:
        got = spark.range(1).select(blocking.df_eligible(F.lit(df), F.lit(shard), 100, 0.0005, mode).alias("x")).first().x
        assert got == want
    with pytest.raises(ValueError):
        blocking.df_eligible(F.lit(1), F.lit(1), 1, 0.0, "other")


def universe(spark):
    legacy = spark.createDataFrame([("S1-1", f"L{i}", i, float(10 - i)) for i in (1, 2, 3)], "source1_entity_id string, candidate_entity_id string, cheap_rank int, cheap_score double")
    near = spark.createDataFrame([("S1-1", c, i, 1 - i / 10) for i, c in ((1, "L1"), (2, "T1"), (3, "T2"))], "source1_entity_id string, candidate_entity_id string, name_tfidf_rank int, name_tfidf_similarity double")
    return fusion.two_channels(legacy, near, 50)


def test_fusion(spark):
    both = universe(spark)
    assert both.count() == 5 and [r.candidate_entity_id for r in both.where("supported_by_both = 1").collect()] == ["L1"]
    assert {c for _, c in pairs(fusion.quota(both, 5, 3, 2))} == {"L1", "L2", "L3", "T1", "T2"}
    ordered = lambda df: [(r.candidate_entity_id, r.fusion_rank) for r in df.orderBy("fusion_rank").collect()]
    assert ordered(fusion.reciprocal_rank(both, 4)) == ordered(fusion.reciprocal_rank(both.orderBy(F.rand(7)), 4))
    assert {"L1", "L2", "L3"} <= {c for _, c in pairs(fusion.hybrid(both, 3, 3))}
    scores = [r.fusion_score for r in fusion.normalized_score(both, 5).collect()]
    assert all(0 <= s <= 1.1 for s in scores)


def test_f05(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source1_entity_id string")
    make = lambda rows: spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string")
    counts = evaluation.entity_metrics(evaluation.entity_counts(ids, make([("a", "x"), ("a", "y"), ("b", "z")]), make([("a", "x"), ("b", "z"), ("c", "w")])))
    got = {r.source1_entity_id: r.f05 for r in counts.collect()}
    assert got["a"] == pytest.approx(5 / 6) and got["b"] == 1.0 and got["c"] == 0.0 and got["d"] == 1.0


def test_samples_and_results(spark):
    feed = spark.createDataFrame([(f"S{2 + i % 2}-{i}",) for i in range(40)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-0")], "source1_entity_id string, candidate_entity_id string")
    ranked = sampling.distractor_ranks(feed, truth, 1)
    small, large = ({r.entity_id for r in sampling.density(ranked, n).collect()} for n in (4, 8))
    assert small < large and "S2-0" not in large
    with pytest.raises(ValueError):
        sampling.density(ranked, 3)
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    listed = submission.result_frame(ids, truth.withColumn("r", F.lit(1)), "r", "candidate_entity_ids")
    assert {r[0]: r[1] for r in listed.collect()} == {"S1-1": "S2-0", "S1-2": ""}
    wrong = spark.createDataFrame([("S1-1", "S2-0,S2-0,S2-2"), ("S1-1", "S9-1")], "source1_entity_id string, matched_entity_ids string")
    found = {r.problem: r.rows for r in submission.violations(ids, feed, wrong, listed).collect()}
    assert found == {"duplicate_source": 1, "missing_source": 1, "unknown_source": 0, "duplicate_match": 1, "wrong_prefix": 1, "unknown_match": 1, "match_not_candidate": 2}


def test_tsv(spark, tmp_path):
    path = str(tmp_path / "s2.tsv")
    with open(path, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-001\tNA\t\tUS\n")
    assert tuple(records.load_source(spark, path, "S2").first()) == ("S2-001", "NA", "", "US")
    with pytest.raises(records.DataValidationError):
        records.load_source(spark, path, "S3")


def small(spark):
    source = frame(spark, [("S1-1", "Blue Harbour Traders Ltd", "12 Mill Road 56001", "US"), ("S1-2", "Maison Rouge", "", "France")])
    feed = frame(spark, [("S2-1", "Blue Harbour Traders", "12 Mill Road 56001", "US"), ("S2-2", "Harbour Lights", "9 Pier 10002", "US"), ("S3-1", "Maison Rouge SARL", "4 rue X 75001", "France"), ("S3-2", "Other Firm", "", "US")])
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1")], "source1_entity_id string, candidate_entity_id string")
    return source, feed, truth


def test_submission_files(spark, tmp_path):
    source, feed, _ = small(spark)
    folder = str(tmp_path / "out")
    paths = stages.submit(source, feed, LinkConfig(), folder)
    matched = {r[0]: r[1] for r in records.read_tsv(spark, paths[0], ["source1_entity_id", "matched_entity_ids"]).collect()}
    assert matched == {"S1-1": "S2-1", "S1-2": "S3-1"}
    with pytest.raises(Exception, match="exists"):
        stages.submit(source, feed, LinkConfig(), folder)
    ids, wrong = source.select(F.col("entity_id").alias("source1_entity_id")), spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S9-9")], "source1_entity_id string, matched_entity_ids string")
    listed = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    with pytest.raises(records.DataValidationError, match="wrong_prefix"):
        submission.write_submission(ids, feed, wrong, listed, str(tmp_path / "bad"))
    with pytest.raises(records.DataValidationError, match="expected columns"):
        submission.write_submission(ids, feed, listed, listed, str(tmp_path / "bad"))


def test_evaluate_report(spark, tmp_path, capsys):
    report = stages.evaluate(*small(spark), LinkConfig(), str(tmp_path / "run"))
    assert report["overall"][0]["macro_f05"] == 1.0 and set(report["seconds"]) == {"normalized", "candidates", "features", "evaluated"}
    assert [json.loads(x)["event"] for x in capsys.readouterr().out.splitlines()] == ["normalized", "candidates", "features", "evaluated"]
    saved = json.loads(spark.read.text(str(tmp_path / "run/report")).first()[0])
    assert saved["config"]["fingerprint"] == LinkConfig().fingerprint()
    with pytest.raises(records.DataValidationError):
        records.read_cache(spark, str(tmp_path / "run/features"), "other")
    assert records.latest(spark, str(tmp_path / "run/*.meta")).endswith(".meta")
    with pytest.raises(FileNotFoundError):
        records.latest(spark, str(tmp_path / "none*"))


def test_guards(spark):
    source, feed, truth = small(spark)
    records.check_records(feed, ("S2-", "S3-"))
    with pytest.raises(records.DataValidationError, match="S3-1"):
        records.check_records(feed, ("S2-",))
    with pytest.raises(records.DataValidationError, match="missing columns"):
        records.check_records(truth.withColumnRenamed("source1_entity_id", "entity_id"), ("S1-",))
    records.check_unique(truth, "source1_entity_id", "candidate_entity_id")
    with pytest.raises(records.DataValidationError):
        records.check_unique(truth.unionByName(truth), "source1_entity_id")
    stray = truth.unionByName(spark.createDataFrame([("S1-9", "S2-1")], truth.schema))
    assert pairs(features.missing_records(stray, source, feed)) == {("S1-9", "S2-1")}
    rows = spark.createDataFrame([(1, 0.5, None)], "label int, a double, b double")
    for bad in (["a", "a"], ["label"], ["c"], ["a", "b"]):
        with pytest.raises(ValueError):
            model.check_features(rows, bad)


def test_files(spark, tmp_path):
    path = str(tmp_path / "truth.tsv")
    with open(path, "w") as f:
        f.write("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n")
    truth = records.load_truth(spark, path, validate=False)
    assert pairs(records.explode_truth(truth)) == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    assert records.count_tsv_rows(spark, path) == 2 and records.inspect_tsv(spark, path)["columns"] == records.TRUTH_COLUMNS
    with open(path, "a") as f:
        f.write("S1-3\tS2-1,S2-1\n")
    with pytest.raises(records.DataValidationError):
        records.load_truth(spark, path)
    with pytest.raises(records.DataValidationError, match="expected columns"):
        records.read_tsv(spark, path, ["a", "b"])


def test_rule_score_and_ratio(spark):
    """The score with the character ratio against a direct version of its rules."""
    import difflib

    source, feed, _ = small(spark)
    found = blocking.generate_candidates(source, feed, LinkConfig())
    rows = features.rule_score(features.pair_features(features.join_records(found, source, feed))).collect()
    names = {r.entity_id: r for r in source.unionByName(feed).collect()}
    assert len(rows) >= 2
    for r in rows:
        l, o = names[r.source1_entity_id], names[r.candidate_entity_id]
        ratio = difflib.SequenceMatcher(None, l.name_full, o.name_full, autojunk=False).ratio()
        assert r.name_character_similarity == pytest.approx(ratio)
        exact = r.name_full_exact or r.name_core_exact or r.name_sorted_exact
        support = r.address_token_jaccard >= 0.25 or r.numeric_token_overlap > 0 or r.address_exact
        strong = r.address_token_jaccard >= 0.6 or r.address_exact
        floors = [0.5 * ratio + 0.25 * r.name_token_jaccard + 0.2 * r.address_token_jaccard + 0.05 * r.name_length_ratio, 0.85 * r.name_sorted_exact, 0.88 * r.name_core_exact, 0.9 * r.name_full_exact, 0.93 * bool(exact and r.same_country)]
        floors += [0.97 * bool(exact and r.same_country and support), 0.95 * bool(ratio >= 0.92 and strong and r.same_country and not r.numeric_token_conflict), 0.94 * bool(r.address_exact and r.name_token_jaccard >= 0.5 and r.same_country)]
        assert r.rule_score == pytest.approx(min(1, max(0, max(floors) - 0.35 * r.country_conflict - 0.12 * r.numeric_token_conflict)))


def test_sweeps(spark):
    """The sweep by changes against counting at every threshold, apart by a column and by groups."""
    import random

    rng = random.Random(5)
    ids = spark.createDataFrame([(f"a{i}", "x" if i % 2 else "y") for i in range(12)], "source1_entity_id string, country string")
    scored = [(f"a{rng.randrange(10)}", f"c{i}", round(rng.random(), 2), round(rng.random(), 2)) for i in range(60)]
    true = {(a, c) for a, c, *_ in scored if rng.random() < 0.4} | {("a11", "z")}
    truth = spark.createDataFrame(sorted(true), "source1_entity_id string, candidate_entity_id string")
    rows = spark.createDataFrame(scored, "source1_entity_id string, candidate_entity_id string, p double, q double")
    grid, alphas = [0.1, 0.25, 0.5, 0.75, 0.99], [0.0, 0.4, 1.0]
    got = {(r.alpha, r.country, r.threshold): (r.macro_f05, r.micro_precision) for r in evaluation.blend_sweep(ids, truth, rows, "p", "q", alphas, grid, ("country",)).collect()}
    assert len(got) == 30
    for (alpha, country, t), found in got.items():
        total, hits, guesses, own = 0.0, 0, 0, [i for i in range(12) if (i % 2 == 1) == (country == "x")]
        for i in own:
            want = {p for p in true if p[0] == f"a{i}"}
            said = {(a, c) for a, c, p, q in scored if a == f"a{i}" and round(p * alpha + q * (1 - alpha), 9) >= t}
            tp = len(want & said)
            total += 1.0 if not want and not said else 1.25 * tp / (1.25 * tp + 0.25 * (len(want) - tp) + len(said) - tp)
            hits, guesses = hits + tp, guesses + len(said)
        assert found == pytest.approx((total / len(own), hits / guesses if guesses else 0.0))
    best = evaluation.best_threshold(evaluation.threshold_sweep(ids, truth, rows, "p", grid), True).collect()
    assert len(best) == 1 and len(model.dense_grid()) == 500 and model.dense_grid()[-1] == pytest.approx(0.995) and len(model.probability_grid()) == 105


def test_taxonomies(spark):
    columns = "l_name_core string, r_name_core string, l_business_name string, r_business_name string, charsim double, name_jaccard double, address_jaccard double"
    cases = [(("a b", "c d", "A dba B", "x", 0.9, 0.9, 0.9), "DBA/trade-name mismatch"), (("alpha", "omega", "", "", 0.1, 0.0, 0.5), "address-only evidence"), (("müller", "muller", "", "", 0.8, 0.0, 0.1), "transliteration/script mismatch"), (("blue sky", "sky blue", "", "", 0.5, 1.0, 0.0), "token reordering"), (("big blue sky", "bbs", "", "", 0.2, 0.0, 0.0), "abbreviation"), (("acme1", "acme2", "", "", 0.8, 0.0, 0.0), "very short/generic name"), (("harbour trading", "zarbaur drading", "", "", 0.6, 0.0, 0.0), "severe spelling corruption"), (("harbour trading", "harbour tradings", "", "", 0.9, 0.3, 0.0), "other")]
    rows = spark.createDataFrame([c for c, _ in cases], columns)
    assert [r.x for r in rows.select(diagnosis.remaining_failure().alias("x")).collect()] == [k for _, k in cases]
    marks = "numeric_token_conflict int, name_full_exact int, name_core_exact int, name_sorted_exact int, address_exact int, address_token_jaccard double, name_character_similarity double, name_shared_token_count int, address_missing_left int, address_missing_right int, l_name_core string, r_name_core string"
    kinds = [((1, 0, 0, 0, 0, 0.0, 0.5, 3, 0, 0, "a", "b"), "numeric-address conflict", "numeric-address conflict"), ((0, 1, 1, 1, 0, 0.1, 1.0, 3, 1, 0, "a", "b"), "same name / different address", "missing address"), ((0, 0, 0, 0, 1, 1.0, 0.6, 3, 0, 0, "ä", "b"), "same address / different business", "transliteration"), ((0, 0, 1, 1, 0, 0.9, 0.9, 3, 0, 0, "a", "b"), "legal suffix only", "other"), ((0, 1, 1, 1, 0, 0.4, 1.0, 3, 0, 0, "a", "b"), "location ambiguity", "other"), ((0, 0, 0, 0, 0, 0.9, 0.5, 3, 0, 0, "a", "b"), "strong lexical noise", "other"), ((0, 0, 0, 0, 0, 0.2, 0.8, 1, 0, 0, "a", "b"), "generic/common business name", "strong name / weak address"), ((0, 0, 0, 0, 0, 0.9, 0.8, 3, 0, 0, "a", "b"), "other high similarity collision", "other")]
    found = spark.createDataFrame([k[0] for k in kinds], marks).select(diagnosis.model_false_positive().alias("a"), diagnosis.classifier_failure().alias("b")).collect()
    assert [(r.a, r.b) for r in found] == [k[1:] for k in kinds]


def test_models_and_projection(spark):
    import random

    rng = random.Random(3)
    rows = spark.createDataFrame([(f"S1-{i}", "S2-1", x := rng.random(), y := rng.random(), int(x + 0.3 * y > 0.6), i >= 80) for i in range(120)], "source1_entity_id string, candidate_entity_id string, x1 double, x2 double, label int, is_validation boolean")
    fits = [model.fit(rows.where("not is_validation"), ["x1", "x2"], rounds=5, min_rows=5, seed=7) for _ in range(2)]
    runs = [[r.score for r in model.predict(m, rows).orderBy("source1_entity_id").collect()] for m in fits]
    assert runs[0] == runs[1] and all(0 <= s <= 1 for s in runs[0]) and len(set(runs[0])) > 2
    forest = model.fit_second(rows, ["x1", "x2"], trees=5)
    shares = [spark.createDataFrame(model.importances(m, ["x1", "x2"]), "feature string, gain double") for m in (fits[0], forest)]
    change = {r.feature: r for r in diagnosis.importance_change(*shares).collect()}
    assert sum(r.before for r in change.values()) == pytest.approx(1) and sum(r.change for r in change.values()) == pytest.approx(0)
    assert model.gain_shares({"same_country": 1.0, "x": 3.0})["country"] == 0.25
    assert diagnosis.runtime_projection(10, 5, 100, 1000, 100, 2000, 300) == pytest.approx({"feed_scale": 2.0, "query_scale": 3.0, "projected_build_seconds": 20.0, "projected_query_seconds": 15.0, "projected_total_seconds": 35.0, "projected_total_hours": 35 / 3600, "projected_index_bytes": 200})
    hard = spark.createDataFrame([(1, 1, 1, 1, 0.5, 0.4, 0.3, 2.0)], "fusion_rank int, relative_name_rank int, relative_tfidf_rank int, relative_address_rank int, name_character_similarity double, address_token_jaccard double, name_tfidf_similarity double, legacy_score double")
    assert hard.select(features.hardness().alias("h")).first().h == pytest.approx(1 + 0.5 + 0.375 + 0.25 + 0.1 + 0.06 + 0.03 + 0.04)


def test_first_entities_and_sufficient_k(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(30)], "source1_entity_id string")
    some = [r[0] for r in sampling.first_entities(ids, 5, 42).collect()]
    assert some == [r[0] for r in sampling.first_entities(ids.orderBy(F.rand(1)), 5, 42).collect()] and len(some) == 5
    assert blocking.smallest_sufficient([(10, 0.8), (20, 0.8997), (30, 0.9)], 0.0005) == 20


def test_stream(spark, tmp_path):
    """A feed that arrives as a stream gives the candidates of the same feed at rest."""
    rows = [("S2-1", "Blue Harbour Traders", "12 Mill Road 56001", "US"), ("S3-1", "Maison Rouge SARL", "", "France")]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source, _, _ = small(spark)
    arriving = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    incremental.link_stream(arriving, source, str(tmp_path / "out"), str(tmp_path / "state"), LinkConfig()).awaitTermination(120)
    assert pairs(spark.read.parquet(str(tmp_path / "out"))) == pairs(blocking.generate_candidates(source, frame(spark, rows), LinkConfig()))


def test_command_line(spark, tmp_path, capsys):
    lines = {"s1": ["S1-1\tBlue Harbour\t1 Road 56001\tUS"], "s2": ["S2-1\tBlue Harbour\t1 Road 56001\tUS"], "s3": ["S3-1\tOther\t\tUS"]}
    for name, own in lines.items():
        (tmp_path / f"{name}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *own]) + "\n")
    args = ["--source1", str(tmp_path / "s1.tsv"), "--feed", str(tmp_path / "s2.tsv"), str(tmp_path / "s3.tsv"), "--out", str(tmp_path / "out")]
    assert cli.main(["--stage", "audit", *args]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--stage", "submit", *args])
    assert cli.main(["--stage", "submit", "--confirm", *args]) == 0 and cli.main(["--stage", "validate", *args]) == 0
    assert '"rows": 1' in capsys.readouterr().out


def test_stable_fraction_and_config(spark):
    import hashlib

    got = spark.createDataFrame([("S1-7",)], "id string").select(text.stable_fraction(F.col("id"), 202603).alias("x")).first().x
    assert got == int.from_bytes(hashlib.blake2b(b"202603:S1-7", digest_size=8).digest(), "big") / 2**64
    assert LinkConfig().fingerprint() == LinkConfig().fingerprint() != LinkConfig(candidate_k=31).fingerprint()
    assert artifact_hash("a", {"k": 1}) == artifact_hash("a", {"k": 1}) != artifact_hash("a", {"k": 2})
    for bad in ({"posting_cap": 0}, {"df_mode": "x"}, {"ngrams": (4, 4)}, {"name_df_fraction": 1.5}, {"max_features": 0}):
        with pytest.raises(ValueError):
            LinkConfig(**bad)


def test_packed_grams(spark):
    """The Arrow gram counts against the built-in ones: same grams, counts and vocabulary."""
    rows = [("S2-1", "blue  harbour a bc"), ("S2-2", ""), ("S2-3", "aa aaa aaaa \u00e9t\u00e9 \U0001f600x"), ("S2-4", "blue blue")]
    feed = spark.createDataFrame(rows, "entity_id string, name_core string").withColumn("country_norm", F.lit("us"))
    plain = tfidf.gram_counts(feed, "name_core", LinkConfig()).collect()
    packed = {r.id: sorted(r.tf) for r in tfidf.packed_grams(feed, "name_core", LinkConfig()).collect()}
    assert packed == {i: sorted(r.tf for r in plain if r.entity_id == i) for i, _ in rows}
    df = {}
    for r in plain:
        df[r.gram] = df.get(r.gram, 0) + 1
    vocab = tfidf.vocabulary(feed, "name_core", LinkConfig()).collect()
    assert {r.gram: r.df for r in vocab} == df and len({r.h for r in vocab}) == len(df)


def test_listed_queries_cost_their_lists(monkeypatch):
    """Queries with a list are scored as over all records, but without an array over the block for each; the largest are found with all that tie."""
    rng, many = np.random.default_rng(3), 3000
    lists = lambda n, kind: pa.array([sorted(rng.choice(400, 12, replace=False).tolist()) for _ in range(n)], pa.list_(kind))
    counts = lambda n: pa.array([[1] * 12] * n, pa.list_(pa.int32()))
    docs = {"id": pa.array([*(f"S2-{i}" for i in range(many)), None]), "g": pa.chunked_array([lists(many, pa.int64()), pa.array([list(range(400))], pa.list_(pa.int64()))]).combine_chunks(), "tf": pa.chunked_array([counts(many), pa.nulls(1, pa.list_(pa.int32()))]).combine_chunks()}
    right = pa.table({**docs, "idf": pa.array([None] * many + [rng.uniform(1, 5, 400).tolist()], pa.list_(pa.float64()))})
    kind = pa.list_(pa.struct([("c", pa.string()), ("m", pa.int32())]))
    chosen = [rng.choice(many + 500, 40, replace=False).tolist() for _ in range(20)]
    left = {"id": pa.array([f"S1-{i}" for i in range(20)]), "g": lists(20, pa.int64()), "tf": counts(20), "pool_size": pa.array([40] * 20, pa.int32())}
    listed = pa.table({**left, "only": pa.array([[{"c": f"S2-{x}", "m": x % 15 + 1} for x in some] for some in chosen], kind)})
    every = tfidf._score_block(many)(None, pa.table({**left, "only": pa.nulls(20, kind)}), right).to_pylist()
    whole, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *args, **more: (whole.append(1) if many in args[2:] else None, plain(*args, **more))[1])
    got = [tuple(r.values()) for r in tfidf._score_block(5)(None, listed, right).to_pylist()]
    assert len(whole) == 1  # the records' norms
    want = []
    for i, some in enumerate(chosen):
        names = {f"S2-{x}": x % 15 + 1 for x in some}
        best = sorted((-r["similarity"], r["candidate_entity_id"]) for r in every if r["source1_entity_id"] == f"S1-{i}" and r["candidate_entity_id"] in names)[:5]
        want += [(f"S1-{i}", x, -s, names[x], 40) for s, x in best]
    assert got == want and len({r[0] for r in got}) > 10
    dots = rng.integers(0, 40, 5000) / 40 + rng.uniform(0, 1e-11, 5000)
    near, rounded = tfidf._largest(dots, 7), dots.round(9)
    assert set(np.flatnonzero(rounded >= np.sort(rounded)[-7])) <= set(near.tolist()) and len(near) < 1000
