"""Golden cases of the demultiplexing plan, end to end over generated block-gzip files, and the matching rules against a model."""

import csv
import gzip
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandsort import samples as S
from strandsort.functions import header as H
from strandsort.functions import segments as G
from strandsort.operators.matching import MatcherKind, with_match
from strandsort.options import Options, load_sheet, parse_args
from strandsort.plans.demux import Demultiplexer, Rules, zip_reads
from strandsort.read_structure import ReadStructure, outputs
from strandsort.run import run
from strandsort.sources import bgzf, discovery

HEAD = "H00233:4:AAAFGW3HV:1:1101:59586:1000"
BARCODES = ["AAAAAAAAGATTACAGA", "CCCCCCCCGATTACAGA", "GGGGGGGGGATTACAGA", "GGGGGGTTGATTACAGA"]


def write_fastq(path, records):
    data = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records).encode()
    with open(path, "wb") as out:
        for b in bgzf.compress(iter([data])):
            out.write(b)
        out.write(bgzf.EOF)
    return str(path)


def read_fastq(path):
    lines = gzip.open(path, "rt").read().splitlines()
    return [(lines[i][1:], lines[i + 1], lines[i + 3]) for i in range(0, len(lines), 4)]


def sheet(path, rows, header="Sample_ID,Sample_Barcode"):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def tsv(path):
    return list(csv.DictReader(open(path), delimiter="\t"))


def test_five_reads(spark, tmp_path):
    seqs = ["AAAAAAAAGATTACAGA", "AAAAAAAAGATTACAGT", "AAAAAAAAGATTACTTT", "GGGGGGTCGATTACAGA", "AAAAAAAAGANNNNNNN"]
    fq = write_fastq(tmp_path / "in.fastq.gz", [(f"{HEAD} 1:N:0:NNNNNNNN frag{i}", s + "A" * 100, "I" * 117) for i, s in enumerate(seqs, 1)])
    out = tmp_path / "out"
    out.mkdir()
    o = Options([fq], sheet(tmp_path / "s.csv", [f"Sample{i},{b}" for i, b in enumerate(BARCODES, 1)]), [ReadStructure.parse("17B100T")], str(out), allowed_mismatches=2, min_delta=1, max_no_calls=1)
    counts = run(spark, o, records_per_task=2)
    assert [counts[f"Sample{i}_S{i}_L001_R1_001.fastq.gz"] for i in range(1, 5)] == [2, 0, 0, 0]
    got = read_fastq(out / "Sample1_S1_L001_R1_001.fastq.gz")
    assert [h for h, _, _ in got] == [f"{HEAD} 1:N:0:{s} frag{i}" for i, s in enumerate(seqs[:2], 1)]
    assert read_fastq(out / "Sample2_S2_L001_R1_001.fastq.gz") == []
    assert [h.split()[-1] for h, _, _ in read_fastq(out / "Undetermined_S5_L001_R1_001.fastq.gz")] == ["frag3", "frag4", "frag5"]
    first = tsv(out / "per_sample_metrics.tsv")[0]
    assert (first["total_matches"], first["perfect_matches"], first["one_mismatch_matches"]) == ("2", "1", "1")
    assert tsv(out / "metrics.tsv") == [{"control_reads_omitted": "0", "failing_reads_omitted": "0", "total_templates": "5"}]
    assert len(tsv(out / "most_frequent_unmatched.tsv")) == 3
    assert tsv(out / "per_project_metrics.tsv")[0]["sample_ID"] == "None"


@pytest.mark.parametrize(("quality", "control", "want"), [(True, True, (1, 2, 1)), (True, False, (2, 2, 0)), (False, True, (2, 0, 2)), (False, False, (4, 0, 0))])
def test_filters(spark, quality, control, want):
    from strandsort.operators.metrics import run_counts

    rows = [(f"{HEAD} 1:{f}:{c}:NNN", "A" * 20, "I" * 20) for f in "YN" for c in "01"]
    t = spark.createDataFrame(rows, "head_0 string, seq_0 string, qual_0 string")
    d = Demultiplexer([S.Sample("a", barcode="A" * 17), S.Sample("u", barcode="N" * 17, ordinal=1)], [ReadStructure.parse("17B+T")], ["T"], Rules(filter_failing_quality=quality, filter_control_reads=control))
    r = run_counts(d.with_drop_reason(t)).first()
    assert (r["total_templates"], r["failing_reads_omitted"], r["control_reads_omitted"]) == want


def test_quality_and_masks(spark):
    qual = "".join(chr(33 + q) for q in range(2, 41))
    df = spark.createDataFrame([("A" * 39, qual)], "s string, q string")
    r = df.select(G.q20_bases(F.col("q")), G.q30_bases(F.col("q")), G.quality_sum(F.col("q")), *[G.n_calls(G.mask(F.col("s"), F.col("q"), t)) for t in (0, 11, 40, 100)]).first()
    assert tuple(r) == (21, 11, sum(range(2, 41)), 0, 9, 38, 39)


def test_header_round_trip(spark):
    heads = [HEAD, f"{HEAD}:ACGT:x", f"{HEAD} 1:N:0:AC", f"{HEAD}:U 2:Y:1:AC+GT other words \n"]
    df = spark.createDataFrame([(h,) for h in heads], "h string").withColumn("p", H.parse_header(F.col("h")))
    assert [r[0] for r in df.select(H.format_header(F.col("p"))).collect()] == [h.rstrip() for h in heads]
    flags = df.select(H.is_control(F.col("p")), H.is_failed_quality_filter(F.col("p")), F.col("p.umi")).collect()
    assert [tuple(r) for r in flags] == [(False, False, None), (False, False, "ACGT:x"), (False, False, None), (True, True, "U")]
    for bad in ("a:b:c", f"{HEAD} 1:N:0", f"{HEAD} text"):
        with pytest.raises(Exception, match="Read header has no"):
            spark.createDataFrame([(bad,)], "h string").select(H.parse_header(F.col("h"))).collect()
    got = spark.createDataFrame([("x:y:z:1:1:1:1 1:N:0:AA+CC+GG",)], "h string").select(*H.header_barcode(H.parse_header(F.col("h")))).first()
    assert tuple(got) == ("AACC+GG", "AA+CC+GG")


def model(kind, observed, expected, m, delta, free):
    """The two decision rules, by enumeration of distances."""
    if kind is MatcherKind.CACHED:
        def dist(e):
            left, d = free, 0
            for o, x in zip(observed, e):
                if o == "N" and left:
                    left -= 1
                elif o != x or o == "N":
                    d += 1
            return d

        ds = [dist(e) for e in expected]
        best = min(ds)
        i = ds.index(best)
        rest = [d for j, d in enumerate(ds) if j != i]
        return (i, best) if best <= m and (not rest or min(rest) - best > delta) else (None, None)
    if len(observed) != len(expected[0]) or set(observed) - set("ACGTN"):
        return None, None
    ds = [sum(o != x for o, x in zip(observed, e)) for e in expected]
    if m == delta == 0:
        return (ds.index(0), 0) if 0 in ds else (None, None)
    n, best = int("N" in observed), min(ds)
    near = [d for d in ds if (d <= m or (d - n >= m + 1 and d <= m + delta - 1)) and d - best <= delta]
    return (ds.index(best), best) if best <= m and len(near) == 1 else (None, None)


@pytest.mark.parametrize("kind", list(MatcherKind))
def test_matching_against_model(spark, kind):
    rng = random.Random(4)
    expected = ["".join(rng.choice("ACGT") for _ in range(17)) for _ in range(5)] if kind is MatcherKind.CACHED else ["AAAAT", "AATTA", "GGGCC", "GGTCA"]
    seen = ["", "acg"] + ["".join(rng.choice("ACGTN") if rng.random() < 0.25 else c for c in rng.choice(expected)) + rng.choice(["", "", "A"]) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in seen], "bc string").coalesce(1)
    for m, delta, free in itertools.product((0, 1, 3), (0, 2), (0, 1)):
        got = [(r.bc, r.sample_ordinal, r.hamming_dist) for r in with_match(df, "bc", expected, kind, m, delta, free).collect()]
        assert got == [(s, *model(kind, s, expected, m, delta, free)) for s in seen]


def test_structures():
    s = ReadStructure.parse("6B1S1M1T")
    assert [(x.kind, x.offset, x.length) for x in s.segments] == [("B", 0, 6), ("S", 6, 1), ("M", 7, 1), ("T", 8, 1)]
    assert str(ReadStructure.parse("8B10S+B").with_fixed_barcodes(30)) == "8B10S12B"
    assert str(ReadStructure.parse("+B").with_fixed_barcodes(20)) == "20B"
    for length in (17, 18):
        with pytest.raises(ValueError):
            ReadStructure.parse("8B10S+B").with_fixed_barcodes(length)
    for bad in ("", "+B8T", "8X", "0T"):
        with pytest.raises(ValueError):
            ReadStructure.parse(bad)
    assert outputs([ReadStructure.parse("17B20T20S20T"), ReadStructure.parse("+T")], ["T", "B"]) == [(0, "B", 1), (0, "T", 1), (1, "T", 2)]


def test_sheets(tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("[Header]\nx,y\n[Demux]\nallowed-mismatches,2\nfilter-control-reads,\nlane,1 2\n[Data]\nSample_ID,Index1_Sequence,Index2_Sequence,Lane,Project\nS1, ac-gt ,TTTT,1,P\n,,,,\nS1,ACGT,TTTT,2,P\nS2,GGGG,CCCC,2,\n")
    found, o = load_sheet(Options(sample_metadata=str(p)))
    assert (o.allowed_mismatches, o.filter_control_reads, o.lane) == (2, True, [1, 2])
    assert [(s.sample_id, s.barcode, s.lane, s.ordinal, s.semantic_barcode) for s in found] == [("S1", "ACGTTTTT", None, 0, "ac-gt+TTTT"), ("S2", "GGGGCCCC", 2, 1, "GGGG+CCCC"), ("Undetermined", "NNNNNNNN", None, 2, "NNNNNNNN")]
    for text, error in (("", S.EmptySheet), ("[Demux]\n", S.NoData), ("[Data]\nSample_ID\n", S.NoSamples), ("[Data]\nSample_ID,Sample_Barcode\nA\n", S.WrongColumnCount), ("Sample_ID,Sample_Barcode\nA,AAAA\nA,TTTT\n", S.DuplicateSampleId), ("Sample_ID,Sample_Barcode\nA,AAAA\nB,AAAA\n", S.BarcodeCollision), ("Sample_ID,Sample_Barcode\nA,AAAA\nB,AATT\n", S.MinDeltaTooHigh), ("Sample_ID,Sample_Barcode\nA,AAAA\nB,AAT\n", S.UnequalBarcodeLengths), ("Sample_ID,Sample_Barcode,Index1_Sequence\nA,AAAA,TT\n", S.BarcodeColumnCollision), ("Sample_ID\nA\nB\n", S.InvalidBarcode), ("[Demux]\nno-such,1\n[Data]\nSample_ID,Sample_Barcode\nA,AA\n", S.DemuxOptionsError)):
        p.write_text(text)
        with pytest.raises(error):
            load_sheet(Options(sample_metadata=str(p)))
    with pytest.raises(ValueError):
        parse_args(["--allowed-mismatches", "-1"])


def test_hops_and_dual_index(spark, tmp_path):
    r = lambda n, s: (f"{HEAD} {n}:N:0:NNN", s + "A" * 10, "I" * 13)
    fq = [write_fastq(tmp_path / f"{i}.gz", [r(i + 1, s) for s in seqs]) for i, seqs in enumerate((["TTT", "TTT"], ["CCC", "AAA"]))]
    o = Options(fq, sheet(tmp_path / "s.csv", ["a,TTT,CCC", "b,GGG,AAA"], "Sample_ID,Index1_Sequence,Index2_Sequence"), [ReadStructure.parse("3B+T")] * 2, str(tmp_path), allowed_mismatches=0, min_delta=0)
    run(spark, o)
    assert tsv(tmp_path / "sample_barcode_hop_metrics.tsv") == [{"barcode": "TTT+AAA", "count": "1"}]
    assert tsv(tmp_path / "most_frequent_unmatched.tsv") == [{"barcode": "TTT+AAA", "count": "1"}]
    assert [x["barcode"] for x in tsv(tmp_path / "per_sample_metrics.tsv")] == ["TTT+CCC", "GGG+AAA", "NNNNNN"]
    assert len(read_fastq(tmp_path / "a_S1_L001_R2_001.fastq.gz")) == 1


def test_bypass_and_bgzf(spark, tmp_path):
    fq = write_fastq(tmp_path / "x.gz", [(HEAD, "ACGTACGTA", "I" * 9)] * 3)
    o = Options([fq], sheet(tmp_path / "s.csv", ["a,"]), [ReadStructure.parse("8B+T")], str(tmp_path))
    assert run(spark, o) == {"a_S1_L001_R1_001.fastq.gz": 3}
    row = tsv(tmp_path / "per_sample_metrics.tsv")[0]
    assert (row["total_matches"], row["perfect_matches"], row["ratio_this_barcode_to_best_barcode"]) == ("3", "0", "inf")
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"x" * 100))
    with pytest.raises(bgzf.NotBlockGzip):
        discovery.resolve([str(tmp_path / "plain.gz")], [ReadStructure.parse("+T")], False, [])
    (tmp_path / "d").mkdir()
    for name in ("p_L001_R1", "p_L002_R1", "p_L001_I1", "p_L002_I1"):
        write_fastq(tmp_path / "d" / f"{name}_001.fastq.gz", [(HEAD, "ACGT", "IIII")])
    groups = discovery.resolve([str(tmp_path / "d" / "p")], [], False, [])
    assert [(str(g.structure), len(g.files)) for g in groups] == [("4B", 2), ("+T", 2)]


def test_zip_join_needs_all_mates(spark):
    a = spark.createDataFrame([(0, "h", "A", "I"), (1, "h", "A", "I")], "k int, head string, seq string, qual string")
    assert zip_reads([a, a], ["k"]).count() == 2
    with pytest.raises(Exception, match="different numbers"):
        zip_reads([a, a.limit(1)], ["k"]).collect()


def many(n, length, rng):
    """Barcodes with pairwise distances of three or more."""
    out = []
    while len(out) < n:
        b = "".join(rng.choice("ACGT") for _ in range(length))
        if all(S.hamming(b, o) > 3 for o in out[-200:]):
            out.append(b)
    return out


@pytest.mark.parametrize("kind", list(MatcherKind))
def test_many_samples(spark, kind):
    """More samples than have a column each: by distinct barcodes, with the same results."""
    rng = random.Random(9)
    expected = many(1536, 16, rng)
    seen = [e for e in expected[:40]] + ["".join(rng.choice("ACGTN") if rng.random() < 0.1 else c for c in rng.choice(expected)) for _ in range(200)] + ["", "ACGT"] + [expected[0]] * 50
    df = spark.createDataFrame([(s,) for s in seen], "bc string")
    want = sorted((s, *model(kind, s, expected, 1, 2, 1)) for s in seen)
    got = sorted((r.bc, r.sample_ordinal, r.hamming_dist) for r in with_match(df, "bc", expected, kind, 1, 2, 1).collect())
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[1] is not None for x in want) > 100


def test_own_matcher(spark):
    """A matcher is a function of distinct barcodes: here one that takes those that begin like a sample's."""
    def by_start(seen, expected):
        starts = spark.createDataFrame([(e[:3], i) for i, e in enumerate(expected)], "s string, sample_ordinal int")
        return seen.join(starts, F.substring("bc", 1, 3) == F.col("s")).select("bc", "sample_ordinal", F.lit(0).alias("hamming_dist"))

    samples = [S.Sample("a", barcode="AAAA"), S.Sample("b", barcode="CCCC", ordinal=1), S.Sample("u", barcode="NNNN", ordinal=2)]
    t = spark.createDataFrame([(HEAD, s + "G", "IIIII") for s in ("AAAT", "CCCC", "GGGG", "NNNN", "AAAT")], "head_0 string, seq_0 string, qual_0 string")
    d = Demultiplexer(samples, [ReadStructure.parse("4B+T")], ["T"], Rules(matcher=by_start))
    assert sorted((r.bc, r.sample_ordinal, r.matched) for r in d.assign(t).collect()) == [("AAAT", 0, True), ("AAAT", 0, True), ("CCCC", 1, True), ("GGGG", 2, False), ("NNNN", 2, False)]


def test_checks_are_not_pruned(spark):
    from strandsort.operators.metrics import per_sample_counts

    samples = [S.Sample("a", barcode="AAAA"), S.Sample("u", barcode="NNNN", ordinal=1)]
    row = lambda a, b, q="IIIII": (f"{a} 1:N:0:N", "AAAAG", q, f"{b} 2:N:0:N", "ACG", "III")
    schema = ", ".join(f"{p}_{i} string" for i in range(2) for p in ("head", "seq", "qual"))
    d = Demultiplexer(samples, [ReadStructure.parse("4B+T"), ReadStructure.parse("+T")])
    good, bad = spark.createDataFrame([row(HEAD, HEAD)], schema), spark.createDataFrame([row(HEAD, HEAD), row(HEAD, HEAD + "1")], schema)
    assert d.assign(good).count() == 1 and Demultiplexer(samples, d.structures, ["T"], Rules(skip_read_name_check=True)).assign(bad).count() == 2
    for ask in (lambda: d.assign(bad).count(), lambda: per_sample_counts(d.assign(bad)).collect(), lambda: d.output_records(d.assign(bad), []).count()):
        with pytest.raises(Exception, match="Read names differ"):
            ask()
    a = spark.createDataFrame([(0, "h", "A", "I"), (1, "h", "A", "I")], "k int, head string, seq string, qual string")
    for ask in (lambda z: z.count(), lambda z: z.select("seq_0", "seq_1").collect(), lambda z: z.filter("k = 1").count()):
        with pytest.raises(Exception, match="different numbers"):
            ask(zip_reads([a, a.limit(1)], ["k"]))
    low = spark.createDataFrame([row(HEAD, HEAD, "IIII\x1f")], schema)
    for q in (G.q20_bases, G.q30_bases, G.quality_sum):
        with pytest.raises(Exception, match="Quality below 33"):
            low.select(q(F.col("qual_0"))).collect()
    with pytest.raises(Exception, match="Quality below 33"):
        per_sample_counts(d.with_quality(d.assign(low))).collect()


def test_high_thresholds_mask_all(spark):
    df = spark.createDataFrame([("ACGT", "~I!~")], "s string, q string")
    assert tuple(df.select(*[G.mask(F.col("s"), F.col("q"), t) for t in (93, 94, 223, 224, 255)]).first()) == ("ANNT", *["NNNN"] * 4)


def test_source_by_ranges_of_bytes(spark, tmp_path):
    """Every way to cut a file gives its records; URIs are read and written like paths."""
    from strandsort.sources import fastq, files

    rng = random.Random(5)
    for name, n, end in (("a", 3000, "\n"), ("b", 3000, ""), ("none", 0, "\n")):
        rows = [(f"{HEAD}{i} 1:N:0:N", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 200))), "") for i in range(n)]
        rows = [(h, s, "".join(chr(33 + rng.randrange(60)) for _ in s)) for h, s, _ in rows]
        data = "\n".join(f"@{h}\r\n{s}\n+\n{q}" for h, s, q in rows).encode() + (end.encode() if rows else b"")
        path = str(tmp_path / f"{name}.fastq.gz")
        with open(path, "wb") as out:
            for b in bgzf.compress(iter([data])):
                out.write(b)
            out.write(bgzf.EOF)
        for size in (9_000, 50_000, 1 << 30):
            marks = fastq.index(spark, [path], 100, size)[path]
            assert marks[-1] == (files.size(path), 4 * n) and marks[-1] == fastq.line_index(path, 400)[-1]
            for first, count in ((0, n), (1, n // 2), (n // 3, n - n // 3)):
                got = [r for part in fastq.records_of(path, marks, first, count, 170) for r in zip(*[c.to_pylist() for c in part])] if count else []
                assert got == rows[first : first + count]
    assert fastq.read_templates(spark, [[f"file://{tmp_path}/a.fastq.gz"], [f"file://{tmp_path}/b.fastq.gz"]], 700).count() == 3000
    (tmp_path / "bad.gz").write_bytes(bgzf.block(b"@h\nAC\n+\nI\n") + bgzf.EOF)
    with pytest.raises(ValueError, match="no whole record"):
        fastq.first_record(str(tmp_path / "bad.gz"))


def test_outputs_go_to_a_uri(spark, tmp_path):
    fq = write_fastq(tmp_path / "x.fastq.gz", [(f"{HEAD}{i} 1:N:0:N", ("AAAA" if i % 3 else "CCCC") + "ACGT", "IIIIIIII") for i in range(50)])
    (tmp_path / "out").mkdir()
    o = Options([fq], sheet(tmp_path / "s.csv", ["a,AAAA", "b,GGGG"]), [ReadStructure.parse("4B+T")], f"file://{tmp_path}/out")
    counts = run(spark, o, records_per_task=7)
    assert sum(counts.values()) == 50 and counts["b_S2_L001_R1_001.fastq.gz"] == 0
    assert [h.split()[0] for h, _, _ in read_fastq(tmp_path / "out" / "a_S1_L001_R1_001.fastq.gz")] == [f"{HEAD}{i}" for i in range(50) if i % 3]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*counts, "metrics.tsv", "most_frequent_unmatched.tsv", "per_project_metrics.tsv", "per_sample_metrics.tsv"])


def test_running_counts_of_a_stream(spark, tmp_path):
    from strandsort.operators.metrics import per_sample_counts
    from strandsort.streaming.runs import running_counts

    samples = [S.Sample("a", barcode="AAAA"), S.Sample("u", barcode="NNNN", ordinal=1)]
    d = Demultiplexer(samples, [ReadStructure.parse("4B+T")])
    schema = "head_0 string, seq_0 string, qual_0 string"
    batches = [[(HEAD, s, "I" * len(s)) for s in seqs] for seqs in (("AAAAC", "AAATC", "CCCCC"), ("AAAAG", "GGGGG"))]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = running_counts(stream, d).writeStream.outputMode("complete").format("memory").queryName(f"counts{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = per_sample_counts(d.with_quality(d.assign(spark.createDataFrame([r for b in batches[: i + 1] for r in b], schema))))
        assert sorted(map(str, spark.table(f"counts{i}").collect())) == sorted(map(str, want.collect()))


def test_numbering(spark):
    from strandsort.operators.numbering import numbered

    rng = random.Random(3)
    rows = [(rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = sorted((r.n, r.a, r.b) for r in numbered(df, ["a", "b"], "n").collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows))]
    assert numbered(df.limit(0), ["a", "b"], "n").count() == 0
