"""Jobs that resume from kept stages, per-chromosome inputs, and the downsampling experiment."""

import os
import shutil

import numpy as np
import pytest

from pairlift.operators import models
from pairlift.operators.matrices import pick_samples
from pairlift.plans import jobs
from pairlift.plans.stages import Stages, StaleStage
from pairlift.sources import genomics as g
from tests.test_plans import cohort, paths  # noqa: F401

STAGES = ["associations", "spans", "contacts", "signal", "features"]


@pytest.fixture(scope="module")
def kept(spark, cohort, tmp_path_factory):  # noqa: F811
    """Files, the folder of a full run's stages, that run's result, and the model."""
    folder = tmp_path_factory.mktemp("kept")
    files = folder / "files"
    shutil.copytree(cohort[0], files)
    found = g.read_matrix(spark, str(files / "snps")).rows.selectExpr("double(values[0]) neg_log10", "double(values[1]) hic", "double(values[2]) recomb", "double(values[3]) label")
    models.save_model(models.fit_regression(found, ["neg_log10", "hic", "recomb"], kind="rf", trees=2, depth=2), str(folder / "model"))
    run(spark, folder, "full", **paths(files))
    return folder, files


def run(spark, folder, out, **how):
    how = {"stages": str(folder / "stages"), "model": str(folder / "model"), "distance": 60_000, **how}
    jobs.detect_job(spark, str(folder / out), **how)
    return result(folder / out)


def result(path):
    return sorted(line for f in path.glob("part-*") for line in f.read_text().splitlines())


def times(folder):
    return {s: os.stat(folder / "stages" / f"{s}.json").st_mtime_ns for s in STAGES}


def test_a_second_run_makes_nothing_and_gives_the_same(spark, kept):
    folder, files = kept
    before = times(folder)
    assert run(spark, folder, "again", **paths(files)) == result(folder / "full") != []
    assert times(folder) == before
    plain = folder / "plain"
    jobs.detect_job(spark, str(plain), model=str(folder / "model"), distance=60_000, **paths(files))
    assert result(plain) == result(folder / "full")


@pytest.mark.parametrize(
    ("given", "without"),
    [
        (["spans"], ["snps", "genes", "snp_loc", "gene_loc"]),
        (["contacts"], ["contacts"]),
        (["signal"], ["signal"]),
        (["spans", "contacts", "signal", "features"], ["snps", "genes", "snp_loc", "gene_loc", "contacts", "signal"]),
    ],
)
def test_given_stages_need_no_files_of_their_own(spark, kept, given, without):
    """A stage that is given stands in for the files that only it needs; the result is the full run's."""
    folder, files = kept
    rest = {k: v for k, v in paths(files).items() if k not in without}
    assert run(spark, folder, "-".join(["given", *given]), given=given, **rest) == result(folder / "full")


def test_stale_stages_are_refused_or_made_anew(spark, kept, tmp_path):
    folder, files = kept
    shutil.copytree(folder / "stages", tmp_path / "stages")
    shutil.copytree(folder / "model", tmp_path / "model")
    shutil.copytree(files, tmp_path / "files")
    own = paths(tmp_path / "files")
    # Copies are other files: their stages are stale as long as the files are named.
    with pytest.raises(StaleStage, match="signal"):
        run(spark, tmp_path, "no", given=["signal"], **own)
    with pytest.raises(StaleStage, match="distance|has changed"):
        run(spark, tmp_path, "no", given=["associations"], **{**paths(files), "distance": 5_000})
    with pytest.raises(StaleStage, match="not there"):
        stages = Stages(spark, str(tmp_path / "stages"), ["truth"])
        stages.add("truth", lambda: None)
        stages.table("truth")
    with pytest.raises(ValueError, match="folder"):
        Stages(spark, None, ["signal"])
    (tmp_path / "files" / "signal").write_text("chr1\t0\t1200000\t5.0\n")
    changed = run(spark, tmp_path, "changed", **own)
    assert len(changed) >= len(result(folder / "full")) and changed != result(folder / "full")
    signal = spark.read.parquet(str(tmp_path / "stages" / "signal"))
    assert signal.where("recomb <> 5.0").count() == 0


def test_truth_is_a_stage_of_training(spark, kept):
    folder, files = kept
    found = spark.read.parquet(str(folder / "stages" / "associations")).select("snp", "gene", "beta", "t_stat", "p_value", "fdr")
    found.write.csv(str(folder / "truth"), sep="\t")
    how = dict(stages=str(folder / "stages"), distance=60_000, k=1, trees=3, depth=2)
    jobs.train_job(spark, str(folder / "a"), truth=str(folder / "truth"), **paths(files), **how)
    jobs.train_job(spark, str(folder / "b"), given=["truth", *STAGES], **how)
    with pytest.raises(ValueError, match="truth"):
        jobs.train_job(spark, str(folder / "c"), given=STAGES, **how)
    features = spark.read.parquet(str(folder / "stages" / "features"))
    one, two = (models.score(models.load_model(str(folder / f / "model")), features).select("key", "prediction") for f in "ab")
    assert one.exceptAll(two).count() == 0 and one.count() > 0


def test_split_by_chromosome(spark, rows, cohort, tmp_path):  # noqa: F811
    """Matrices, locations and covariates of each chromosome hold the chosen samples, and rows come back as they were."""
    files = cohort[0]
    loc = [line.split("\t") for line in (files / "snp_loc").read_text().splitlines()[1:]]
    moved = tmp_path / "loc"
    moved.write_text("id\tchr\tpos\n" + "".join(f"{s}\t{'0' + str(i % 3) if i % 5 else 'X'}\t{p}\n" for i, (s, _, p) in enumerate(loc) if i % 7))
    cov = tmp_path / "cov"
    names = (files / "snps").read_text().splitlines()[0].split("\t")[1:]
    cov.write_text("\n".join("\t".join(r) for r in [["id", *names], ["age", *["1.5"] * 59, "NA"], ["sex", *["0.0"] * 60]]) + "\n")
    p = paths(files)
    jobs.split_job(spark, str(tmp_path / "out"), snps=p["snps"], genes=p["genes"], snp_loc=str(moved), gene_loc=p["gene_loc"], covariates=str(cov), size=20)
    at = pick_samples(names, 20)
    got = g.read_matrices_by_chromosome(spark, str(tmp_path / "out" / "snps"))
    assert got.samples == [names[i] for i in at]
    whole = {r["id"]: r["values"] for r in g.read_matrix(spark, p["snps"]).rows.collect()}
    want = sorted((f"s{i}", "0" + str(i % 3) if i % 5 else "X", [whole[f"s{i}"][j] for j in at]) for i in range(120) if i % 7)
    assert sorted((r["id"], r["chr"], r["values"]) for r in got.rows.collect()) == want
    covs = g.read_matrices_by_chromosome(spark, str(tmp_path / "out" / "covariates")).rows.collect()
    assert sorted((r["chr"], r["id"]) for r in covs) == sorted((c, i) for c in ("00", "01", "02", "X", "chr1") for i in ("age", "sex"))
    one = g.read_matrix(spark, str(tmp_path / "out" / "snps" / "chr=X"))
    assert one.samples == got.samples and one.rows.count() == sum(1 for _, c, _ in want if c == "X")


def test_downsample_job_finds_planted_pairs_in_every_draw(spark, cohort, tmp_path):  # noqa: F811
    p = paths(cohort[0])
    where = {k: p[k] for k in ("snps", "genes", "snp_loc", "gene_loc")}
    jobs.downsample_association_job(spark, str(tmp_path / "d"), sizes=[30, None], seeds=[1, 2], chroms=["chr1"], distance=60_000, p_trans=1e-6, **where)
    schema = "snp string, gene string, beta double, t_stat double, p_value double, fdr double, subset string, kind string"
    found = spark.read.csv(str(tmp_path / "d"), schema=schema, sep="\t", header=True)
    planted = cohort[1]
    for name, size in (("30.1", 30), ("30.2", 30), ("60.1", 60), ("60.2", 60)):
        cis = found.where(f"subset = '{name}' AND kind = 'cis'").orderBy("p_value").collect()
        hits = {(r["snp"], r["gene"]) for r in cis[: len(planted)]}
        assert len(hits & set(planted.items())) >= (8 if size == 30 else 10)
    best = {r["subset"]: r["t"] for r in found.where("kind = 'cis'").groupBy("subset").agg({"t_stat": "max"}).withColumnRenamed("max(t_stat)", "t").collect()}
    assert best["60.1"] == best["60.2"] > max(best["30.1"], best["30.2"]) and not np.isclose(best["30.1"], best["30.2"])
