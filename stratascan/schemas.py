"""Column types of the engine's text files. Slices are keyed by whole hundredths of m/z, never by text or floats."""

SCAN_MAP = (
    "file string, spectrum_index int, level tinyint, rt double, mz double, intensity double, prec_mz double, "
    "prec_isolation_window_start double, prec_isolation_window_end double"
)
NOVOR = "id string, scan string, rt string, mz string, z string, pep_mass string, err string, ppm string, score string, peptide string, aa_score string"
DEEPNOVO = "scan string, output_seq string, output_score string"
SPECTRUM_INDEX = "swath int, rt_window int, ncomp int, model_id long, spectrum_num int, scan long"
MEASURES = "swath int, rt_window int, ncomp int, rsq double, iterations int"
# The columns of the tabular alignment format, in order.
BLAST = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
