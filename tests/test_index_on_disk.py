"""What building and searching a saved index leaves on disk, and what it makes twice."""

import os
import random

import numpy as np
import pytest

from lzseq.functions import session
from lzseq.operators import fm
from lzseq.plans import index, jobs


@pytest.fixture
def fasta(tmp_path):
    rng = random.Random(12)
    text = {f"s{i}": "".join(rng.choices("ACGT", k=600 + i)) for i in range(12)}
    (tmp_path / "fasta").mkdir()
    (tmp_path / "fasta" / "a.fa").write_text("".join(f">{k} x y chromosome 1, scaffold\n{v}\n" for k, v in text.items()))
    return str(tmp_path), text


def folders(spark):
    return set(os.listdir(session.shared_folder(spark).removeprefix("file:")))


def test_search_structure_is_made_once_by_halves(spark, fasta, monkeypatch):
    folder, text = fasta
    made = []
    monkeypatch.setattr(fm, "blocks", lambda *a, of=fm.blocks: made.append(a) or of(*a))
    jobs.kernelize_fasta(spark, f"{folder}/fasta", f"{folder}/index", index.Parameters(24, 0, ""), method="relative", block_chars=2_000)
    assert not made and not {"kernels", "blocks", "directory"} & set(os.listdir(f"{folder}/index"))
    jobs.index_kernels(spark, f"{folder}/index")
    assert len(made) == 1
    (spark.createDataFrame([(text["s3"][40:64],), (text["s7"][1:25],)], "value string")).coalesce(1).write.text(f"{folder}/patterns")
    found = jobs.find_patterns(spark, f"{folder}/index", f"{folder}/patterns").collect()
    assert sorted((r.query_id, r.name, r.pos) for r in found) == [(0, "s3", 40), (1, "s7", 1)]


def test_what_lies_between_files_and_index_goes(spark, fasta):
    folder, _ = fasta
    jobs.fasta_sequences(spark, f"{folder}/fasta").count()  # the session's folder of checkpoints is there
    before = folders(spark)
    jobs.index_fasta(spark, f"{folder}/fasta", f"{folder}/index", index.Parameters(24, 0, ""))
    assert folders(spark) == before and not session._scratch
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(session.shared_folder(spark).removeprefix("file:")) for f in files if "scratch" in f) == 0
    assert index.Index.load(spark, f"{folder}/index").catalogue.count() == 12


def test_scratch_goes_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        assert session.keep(spark.range(3)).count() == 3
        1 / 0
    assert not session._scratch and not [x for x in folders(spark) if x.startswith("scratch-")]
    assert session.keep(spark.range(3)).count() == 3


def test_directory_has_a_row_for_a_text_and_bucket(spark):
    rng = random.Random(13)
    texts = [("a", "".join(rng.choices("ACGT", k=5_000))), ("b", "ACGT" * 200), ("short", "ACGTACGT"), ("none", None), ("empty", "")]
    rows = fm.directory(spark.createDataFrame(texts, "key string, text string")).collect()
    assert len(rows) == len({(r.key, r.part) for r in rows}) <= 2 * fm.BUCKETS and {r.key for r in rows} == {"a", "b"}
    from lzseq.operators import kernels

    for key, text in texts[:2]:
        hashes = kernels.window_hashes(text, fm.GRAM)
        part, gram = fm.part_of(np.unique(np.lib.stride_tricks.sliding_window_view(hashes, fm.WINDOW).min(1)))
        assert {(r.part, g) for r in rows if r.key == key for g in r.grams} == set(zip(part.tolist(), gram.tolist()))


def test_kept_in_the_outer_scratch_outlives_the_inner(spark):
    with session.scratch(spark):
        with session.scratch(spark):
            gone, stays = session.keep(spark.range(5)), session.keep(spark.range(7), outer=True)
            assert gone.count() == 5
        assert stays.count() == 7 and len([x for x in folders(spark) if x.startswith("scratch-")]) == 1
