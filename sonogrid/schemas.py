"""Schemas of annotation documents, files and metrics. Nothing is inferred when reading."""

from __future__ import annotations

UNIT = "struct<onset_ms:double,offset_ms:double,id:int>"
EVENT = f"struct<onset_ms:double,offset_ms:double,units:array<{UNIT}>>"
RECORDING = "struct<filename:string,bird_id:string,detected_vocalizations:int>"
ANNOTATIONS = f"metadata struct<units:string>, recordings array<struct<recording:{RECORDING},detected_events:array<{EVENT}>>>"
AUDIO_PARAMS = "mels int, sr int, hop_size int, fft int, mean double, std double"
DETECTIONS = "filename string, song_present boolean, segments array<struct<onset_timebin:bigint,offset_timebin:bigint,onset_ms:double,offset_ms:double>>, source_group string"
MANIFEST = "config string, species string, src string, start double, end double, dst string"
BIRDS = "species string, bird_id string, seconds string"
METRICS = (
    "f1 string, fer string, probe_mode string, mode string, species string, bird string, train_seconds string, num_classes string, num_classes_train string, num_classes_val string, "
    "patch_width string, frozen_layers string, steps string, lr string, batch_size string, class_weighting string, run_name string, created_at string"
)
LOSSES = "step bigint, train_loss double, val_loss double, gnorm double, samples_processed bigint, steps_per_sec double, samples_per_sec double"
SPECS = "stem string, n_mels int, n_timebins bigint, spec array<array<float>>"
