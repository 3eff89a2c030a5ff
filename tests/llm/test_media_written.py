"""op2 reads back what it has written: the media column, then the PCM column, are tables in the shared folder."""

import struct
from hashlib import sha256

from oracle import SF

from stemma.llm import catalog, media, shared


def test_columns_are_written_and_reread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    kept = []
    monkeypatch.setattr(media, "discard", lambda *tables: kept.extend(tables))
    got = catalog.op2_media_columns(spark, SF)
    media_dir, pcm_dir = (list((tmp_path / "stemma").glob(f"{k}-*")) for k in ("media", "pcm"))
    assert len(media_dir) == len(pcm_dir) == 1 and got.inputFiles() and all(str(pcm_dir[0]) in f for f in got.inputFiles())
    docs = catalog.table(spark, SF, "documents")
    stored = spark.read.parquet(str(media_dir[0]))
    assert stored.count() == docs.count() and kept
    plain = {r["doc_id"]: r for r in media.read_back(stored).collect()}
    for r in got.collect():
        pcm = bytes(plain[r["doc_id"]]["pcm"])
        assert media.parsed(pcm)[:2] == ("pcm", media.PCM_RATE) and struct.unpack_from("<I", pcm, 4)[0] == len(pcm) - 8
        assert (r["pcm_bytes"], r["pcm_sha256"], r["media_sha256"]) == (len(pcm), sha256(pcm).hexdigest(), plain[r["doc_id"]]["media_sha256"])
