import base64
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascan import config
from stratascan.functions import encoding, peptides, scalars
from stratascan.plans import pipeline
from stratascan.sources import scans, tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, scalars.without_ptm(F.lit("PEP(O)TI(P)DE"))) == "PEPDE"
    assert one(spark, scalars.without_ptm(F.lit("PEP(O)TI(P)DE"), greedy=False)) == "PEPTIDE"
    assert one(spark, scalars.title_scan(F.lit("controllerType=0 scan=57_x"))) == "57"
    assert one(spark, scalars.quality_digit(F.lit("/a/map_Q2_crux.tsv"))) == "2"
    assert one(spark, scalars.text_key(F.lit(1234.125))) == "1234.12"
    assert one(spark, F.struct(*scalars.path_keys(F.lit("/x/swath_lower_adjusted=1,234.50/rt_window=3.0/m.pt")))) == (123450, 3)
    assert one(spark, scalars.mz_label(F.lit(100.01), F.lit(1))) == "100.0100_ms1"


def test_digest_and_decoys(spark):
    assert one(spark, peptides.digest(F.lit("MKPARGGKLL"))) == ["MKPAR", "GGK", "LL"]
    for text, want in {"ABCDEFGH": "ABCFGHDE", "ABCD": "BCDA", "AB": "AB"}.items():
        assert one(spark, peptides.rotated(F.lit(text))) == want, text
    rows = spark.createDataFrame([("MKPARGGKLLWWWWWWK",), (None,)], "q string")
    for mode in ("random", "random_center", "random_end"):
        a, b = ([r.q for r in peptides.mutate_sequences(rows, "q", mode).collect()] for _ in range(2))
        assert a == b and sorted(a[0]) == sorted("MKPARGGKLLWWWWWWK") and a[1] is None


def test_names_and_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1, 2, 3)], "x int, z int, y int")
    assert scalars.new_columns(a, b) == ["z", "y"]
    paths = spark.createDataFrame([("b",), ("a",)], "path string")
    assert [r.path for r in tables.first_file(paths).collect()] == ["a"]
    sizes = {r.x for r in scalars.seeded_sample(spark.range(50).withColumnRenamed("id", "x"), "x", 7).collect()}
    assert len(sizes) == 7 and sizes == {r.x for r in scalars.seeded_sample(spark.range(50).withColumnRenamed("id", "x").repartition(3), "x", 7).collect()}
    names = spark.createDataFrame([("/d/file=s1/part-0.csv",), ("/d/run.2.csv",), ("run",)], "p string")
    assert [r.n for r in names.select(tables.file_stem(F.col("p")).alias("n")).collect()] == ["s1", "run.2", "run"]


def test_random_decoys_move_the_places_of_their_mode(spark):
    texts = ["ABCDEFGHIJLMNO", "ABCDEFGH", "AB", "A", "", "GKPGRLLK"]
    rows = spark.createDataFrame([(t,) for t in texts], "q string")
    of = lambda mode, seed=42: [r.q for r in peptides.mutate_sequences(rows, "q", mode, seed=seed).collect()]
    for seed in range(6):
        some, centre, end = of("random", seed), of("random_center", seed), of("random_end", seed)
        for got in (some, centre, end):
            assert [sorted(g) for g in got] == [sorted(t) for t in texts]
        assert all(g != t and g[-1] == t[-1] for g, t in zip(some[:2], texts[:2], strict=True)) and some[2:5] == texts[2:5]  # half of the places but the last
        assert centre[0][:4] == "ABCD" and centre[0][10:] == "LMNO" and end[0][:9] == "ABCDEFGHI"
    assert of("random", 1) != of("random", 2)


def test_fragments(spark):
    rows = spark.createDataFrame([("PEPTIDE",)], "q string")
    got = {(r.ion, r.length): r.mz for r in peptides.fragments(rows, "q").collect()}
    assert len(got) == 10 and got["b", 2] == pytest.approx(227.10263, abs=1e-4) and got["y", 1] == pytest.approx(148.06043, abs=1e-4)


def test_evalue_threshold(spark):
    rows = spark.createDataFrame([("A" * n,) for n in (9, 10, 11)], "s string")
    assert peptides.evalue_threshold(rows, "s", spark.createDataFrame([(21,)], "n int")).first().evalue == 11


MZML = """<?xml version="1.0"?><mzML><run><spectrumList>{}</spectrumList></run></mzML>"""


def mzml_spectrum(index, level, minutes, mz, intensity, precursor=None, packed=False):
    def array(accession, values, kind):
        raw = np.array(values, kind).tobytes()
        bits = '<cvParam accession="MS:1000521"/>' if kind == "<f4" else '<cvParam accession="MS:1000523"/>'
        z = '<cvParam accession="MS:1000574"/>' if packed else ""
        return f'<binaryDataArray>{bits}{z}<cvParam accession="{accession}"/><binary>{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</binary></binaryDataArray>'

    pre = ""
    if precursor:
        target, lower, upper = precursor
        pre = f'<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="{target}"/><cvParam accession="MS:1000828" value="{lower}"/><cvParam accession="MS:1000829" value="{upper}"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{target}"/></selectedIon></selectedIonList></precursor></precursorList>'
    time = f'<scanList><scan><cvParam accession="MS:1000016" value="{minutes}" unitAccession="UO:0000031" unitName="minute"/></scan></scanList>' if minutes is not None else ""
    return f'<spectrum index="{index}"><cvParam accession="MS:1000511" value="{level}"/>{time}{pre}<binaryDataArrayList>{array("MS:1000514", mz, "<f8")}{array("MS:1000515", intensity, "<f4")}</binaryDataArrayList></spectrum>'


def test_mzml(spark, tmp_path):
    body = [
        mzml_spectrum(0, 1, 1.5, [410.0, 500.0], [5.0, 0.5]), mzml_spectrum(1, 2, 1.51, [100.0, 200.0], [5.0, 0.5], (412.5, 12.5, 12.5), packed=True),
        mzml_spectrum(2, 2, 1.52, [100.0], [9.0]), mzml_spectrum(3, 1, None, [100.0], [9.0]),
    ]
    (tmp_path / "run7.mzML").write_text(MZML.format("\n".join(body)))
    got = sorted((r.file, r.spectrum_index, r.level, r.rt, r.mz, r.intensity, r.prec_mz, r.prec_isolation_window_start, r.prec_isolation_window_end) for r in scans.read_mzml(spark, str(tmp_path / "run7.mzML"), min_intensity=1.0).collect())
    assert got == [("run7", 0, 1, 90.0, 410.0, 5.0, 410.0, 400.0, 425.0), ("run7", 1, 2, 90.6, 100.0, 5.0, 412.5, 400.0, 425.0)]
    assert scans.time_unit(spark, str(tmp_path / "run7.mzML")).first().unit == "minute"
    (r,) = scans.spectrum_problems(spark, str(tmp_path / "run7.mzML")).collect()
    assert (r.file, r.processed, r.problematic) == ("run7", 4, 1)
    (tmp_path / "seconds.mzML").write_text(MZML.format("").replace("minute", "second"))
    assert scans.time_unit(spark, str(tmp_path / "seconds.mzML")).count() == 0


def test_mzxml_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(n, lv, float(m), float(i)) for n in (1, 2) for lv, m, i in ((1, 400 + n, 7), (1, 300, 3), (2, 200, 5), (2, 100, 9))], "scan long, level int, mz double, intensity double")
    path = str(tmp_path / "out.mzXML")
    scans.write_mzxml(scans.mzxml_scans(rows), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out.mzXML").glob("part-*")))
    ElementTree.fromstring(data)
    assert b'scanCount="2"' in data
    at = int(data.split(b"<indexOffset>")[1].split(b"<")[0])
    assert data[at:].startswith(b"<index")
    offsets = [int(x.split(b">")[1].split(b"<")[0]) for x in data[at:].split(b"<offset")[1:]]
    assert len(offsets) == 2 and all(data[o:].startswith(b'<scan num="%d"' % n) for n, o in enumerate(offsets, 1))
    got = {r.num: (r.prec_mz, r.prec_intensity, [(p.mz, p.intensity) for p in r.peaks]) for r in scans.read_mzxml(spark, path).collect()}
    assert got == {n: (400.0 + n, 7.0, [(100.0, 9.0), (200.0, 5.0)]) for n in (1, 2)}


def test_mgf_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(n, 400.5, 7.0, 2, [(100.25, 9.0), (200.5, 5.0)]) for n in (1, 2)], "scan long, prec_mz double, prec_intensity double, charge int, peaks array<struct<mz:double,intensity:double>>")
    scans.write_text(scans.mgf_text(rows), str(tmp_path / "mgf"))
    (tmp_path / "more.mgf").write_text("BEGIN IONS\nSEQ=PEPTIDE\nSCANS=9\nPEPMASS=1.5\nTITLE=x\n50.5 1\nEND IONS\n\nBEGIN IONS\nTITLE=empty\nPEPMASS=2\nEND IONS\n")
    got = scans.read_mgf(spark, str(tmp_path / "mgf")).collect()
    assert sorted(r.title for r in got) == ["scan=1", "scan=2"] and all([tuple(p) for p in r.peaks] == [(100.25, 9.0), (200.5, 5.0)] and r.charge == "2" and r.seq == "" for r in got)
    (r,) = scans.read_mgf(spark, str(tmp_path / "more.mgf")).collect()
    assert (r.seq, r.scans, r.pepmass, r.title) == ("PEPTIDE", "9", 1.5, "x")


def test_fasta(spark, tmp_path):
    (tmp_path / "db.fasta").write_text(">a one\nMKP\nARG\n>b\nGGK\n")
    path = str(tmp_path / "db.fasta")
    assert scans.fasta_records(spark, path).first().n == 2
    assert sorted(tuple(r) for r in scans.read_fasta(spark, path).collect()) == [("a one", "MKPARG"), ("b", "GGK")]
    rows = spark.createDataFrame([(1, "MK")], "id int, s string")
    assert scans.fasta_text(rows, "id", "s").first().value == ">1\nMK"


def test_result_tables(spark, tmp_path):
    (tmp_path / "w.csv").write_text("start,end\n400,425\n424,450\n")
    assert sorted(tuple(r) for r in tables.windows_csv(spark, str(tmp_path / "w.csv")).collect()) == [(400.0, 425.0), (424.0, 450.0)]
    (tmp_path / "n.csv").write_text("# x\n1, 57, 1.0, 400, 2, 799, 0, 0, 88.5, PEP(O)TIDE, 1-2\n")
    assert [tuple(r) for r in tables.sequencing_results(spark, [str(tmp_path / "n.csv")], "novor").collect()] == [("57", "PEPTIDE", 88.5)]
    (tmp_path / "d.tsv").write_text("scan\toutput_seq\toutput_score\n5\tP,Emod,P\t-0.5\n6\t\t\n")
    assert [tuple(r) for r in tables.sequencing_results(spark, [str(tmp_path / "d.tsv")], "deepnovo").collect()] == [("5", "PEP", -0.5)]
    (tmp_path / "map_Q3_x.tsv").write_text("scan\tscore\n1\t2\n")
    (r,) = tables.psm_tables(spark, str(tmp_path / "map_Q3_x.tsv")).collect()
    assert r.quality == "3" and r.file.endswith("map_Q3_x.tsv")
    (tmp_path / "bad_Q1.tsv.gz").write_bytes(b"no gzip at all")
    got = tables.psm_tables(spark, str(tmp_path / "map_Q3_x.tsv"), str(tmp_path / "bad_Q1.tsv.gz"), schema="scan long, score long").collect()
    assert [(r.scan, r.score) for r in got] == [(1, 2)]
    got = tables.sequencing_results(spark, [str(tmp_path / "d.tsv"), str(tmp_path / "bad_Q1.tsv.gz")], "deepnovo").collect()
    assert [tuple(r) for r in got] == [("5", "PEP", -0.5)]
    d = tmp_path / "swath_lower_adjusted=400.50" / "rt_window=2.0"
    d.mkdir(parents=True)
    (d / "log.csv").write_text("ncomp,rsq\n2,0.5\n")
    got = tables.slice_results(spark, str(tmp_path / "swath_lower_adjusted=400.50"), "ncomp int, rsq double").collect()
    assert [(r.swath, r.rt_window, r.ncomp, r.rsq) for r in got] == [(40050, 2, 2, 0.5)]


def test_peaks_survive_base64(spark):
    rows = spark.createDataFrame([([1.5, 2.25], [3.0, 4.0]), (None, None)], "m array<double>, i array<double>")
    got = rows.select(encoding.base64_to_peaks(encoding.peaks_to_base64("m", "i")).alias("p")).collect()
    assert [tuple(p) for p in got[0].p] == [(1.5, 3.0), (2.25, 4.0)] and got[1].p is None
    raw = rows.select(encoding.peaks_to_base64("m", "i").alias("t")).first().t
    assert base64.b64decode(raw) == np.array([1.5, 3.0, 2.25, 4.0], ">f4").tobytes()


def test_config(tmp_path):
    assert config.from_mapping({"mass_tol_ppm": "20", "other": 1}).mass_tol_ppm == 20.0
    for bad in ({"analysis_pipeline": "tpp"}, {"parafac_init": "x"}, {"parafac_min_comp": 5, "parafac_max_comp": 2}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)
    (tmp_path / "c.yaml").write_text("mass_tol_ppm: 12\nsequencer: deepnovo\n")
    assert (config.from_yaml(str(tmp_path / "c.yaml")).mass_tol_ppm, config.from_yaml(str(tmp_path / "c.yaml")).sequencer) == (12.0, "deepnovo")
    path = str(tmp_path / "v.yaml")
    config.upsert_value(path, "max_rt", 5.0)
    assert config.upsert_value(path, "other", 1) == {"max_rt": 5.0, "other": 1}


def test_whole_run(spark):
    """Two components with Gaussian profiles in three samples."""
    t, rows = np.arange(12), []
    for s, (a, b) in enumerate(((1.0, 2.0), (2.0, 1.0), (3.0, 0.5))):
        for j in t:
            for centre, weight, masses in ((4, a, (200.0, 300.0)), (8, b, (250.0, 350.0))):
                profile = 100 * weight * np.exp(-0.5 * ((j - centre) / 1.2) ** 2)
                for level, mz in ((1, 410.0 + centre), *((2, m) for m in masses)):
                    rows.append((f"s{s}", int(j), level, float(j) * 2 + (0 if level == 1 else 0.5), mz, float(profile + 0.01), 410.0, 400.0, 425.0))
    scan = spark.createDataFrame(rows, "file string, spectrum_index int, level int, rt double, mz double, intensity double, prec_mz double, prec_isolation_window_start double, prec_isolation_window_end double")
    cfg = config.Config(parafac_min_comp=2, parafac_max_comp=2, last_cycle_sec=1.0, parafac_max_iter=1500, parafac_tolerance=1e-9)
    out = pipeline.run(scan, cfg)
    (m,) = out.measures.collect()
    assert m.rsq > 0.999
    assert out.best.count() == 1 and out.abundances.count() == 6
    ratio = {}
    for r in out.abundances.collect():
        ratio.setdefault(r.scan, {})[r.sample_num] = r.abundance
    found = sorted(round(v[2] / v[0], 1) for v in ratio.values())
    assert found == pytest.approx([0.25, 3.0], abs=0.1)
    rebuilt = out.scan_map.collect()
    assert rebuilt and {r.level for r in rebuilt} == {1, 2} and min(r.intensity for r in rebuilt) >= 0 and {r.model_id for r in rebuilt} == {r.model_id for r in out.best.collect()}
    assert {r.mz for r in out.spectra.where("level = 2").collect()} <= {200.0, 250.0, 300.0, 350.0}
