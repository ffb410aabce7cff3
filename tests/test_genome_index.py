import io
import random

import pytest

from helixframe.sources import fasta, genome


def written(records, width, end="\n", closed=True):
    text = "".join(f">{name} note{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for name, s in records)
    return text if closed else text.rstrip("\r\n")


@pytest.mark.parametrize("end,closed", [("\n", True), ("\n", False), ("\r\n", True)])
def test_context_as_from_chunks(spark, tmp_path, end, closed):
    rng = random.Random(4)
    records = [(f"acc{i}", "".join(rng.choices("acgtN", k=n))) for i, n in enumerate((1, 59, 60, 61, 600, 1201, 0))]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.fa").write_text(written(records[:4], 60, end, closed))
    (tmp_path / "g" / "b.fa").write_text(written(records[4:], 37, end, closed))
    index = genome.genome_index(spark, str(tmp_path / "g"), 50)
    assert {r.accession: r.total for r in index.collect()} == {n: len(s) for n, s in records}
    rows = [(i, name, p, s[p - 1 : p - 1 + n].upper() or "A") for i, (name, s, p, n) in enumerate((name, s, p, rng.randrange(1, 5)) for name, s in records[:6] for p in {1, len(s), max(1, len(s) // 2), max(1, len(s) - 3)})]
    rows.append((999, "none", 3, "A"))
    v = spark.createDataFrame(rows, "variant_id long, accession string, position long, ref_allele string")
    plain = fasta.chunks(spark.createDataFrame(records, "accession string, sequence string"), 100)
    want = sorted(map(tuple, fasta.with_context(v, plain, 25, 100).select("variant_id", "position", "flank_1", "flank_2", "ref_matches").collect()))
    got = genome.with_context(v, index, str(tmp_path / "g"), 25)
    assert got.columns == [*v.columns, "flank_1", "flank_2", "ref_matches"]
    assert sorted(map(tuple, got.select("variant_id", "position", "flank_1", "flank_2", "ref_matches").collect())) == want and len(want) == len(rows) - 1


def test_reads_follow_the_variants():
    """Few variants read few bytes, wherever they are; many near ones share reads."""

    class Counted(io.BytesIO):
        taken = 0
        reads = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken, self.reads = self.taken + len(data), self.reads + 1
            return data

    data = b"ACGT" * (1 << 20)
    f = Counted(data)
    spans = [genome.Span(a, a + 100, i) for i, a in enumerate((5, 2_000_000, 4_000_000))]
    assert [t for _, t in sorted(genome.fetched(f, spans))] == [data[s.start : s.end].decode() for s in spans]
    assert f.taken == 300 and f.reads == 3
    f = Counted(data)
    near = [genome.Span(a, a + 100, i) for i, a in enumerate(range(0, 1_000_000, 500))]
    assert len(list(genome.fetched(f, near))) == 2000 and f.reads == 1 and f.taken <= 1_000_000


def test_no_index_of_compressed_files(spark, tmp_path):
    (tmp_path / "g.fa.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="compressed"):
        genome.genome_index(spark, str(tmp_path / "g.fa.gz"))
