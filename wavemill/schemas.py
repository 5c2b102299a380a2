"""Explicit schemas of the engine's tables, as DDL."""

SIGNALS = "file_id string, sr int, n_samples long, samples array<float>"
CASES = "name string, path string, spliced boolean, gt_times array<double>, tier int"
CASE_JSON = "map<string, struct<path: string, spliced: boolean, splice_time_sec: variant, tier: int>>"
HITS = "file_id string, mode string, seg_no int, coarse_t double, score double, threshold double, t double"
SCORES_LOG = "commit string, val_bpb double, memory_gb double, status string, description string"
PROTOCOL_LOG = "commit string, splice_f1 double, precision double, recall double, fp_rate double, status string, description string"
