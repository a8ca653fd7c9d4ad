import hashlib
import zlib

from wireloom.llm import media
from wireloom.llm.common import fresh_path, table


def pad(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_round_trip():
    for text in (None, "", "a", "x" * 64, "y" * 65, "é漢🙂" * 999):
        n, payload = media.payload_of(text)
        assert payload == pad(text) and n == len((text or "").encode())
        stored = media.encode_picture(payload)
        assert media.decode_picture(stored) == payload and media.read_text(stored, n) == (text or "")
        assert media.read_header(stored[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8)


def test_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = media.op7_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        payload = pad(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(docs[r.doc_id].encode()), len(payload), sha(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.height * 64 == len(payload)
        stored = media.encode_picture(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), sha(stored), media.feature(payload))


def test_edges_and_shards(spark, monkeypatch):
    rows = [(1, None, 0), (2, "", 1), (None, "x", 2), (3, "same", 3), (3, "same", 4), (4, "same", 5), (5, "long " * 100_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").coalesce(1)
    root = fresh_path(spark, "media-test")
    index = media.write_media(docs, root)
    assert sorted((r.doc_id or 0, r.n_bytes) for r in index.collect()) == sorted((i or 0, len((t or "").encode())) for i, t, _ in rows)
    places = media.place_of(index).collect()
    assert len(places) == 4
    store, base = media._store(root)
    for r in places:
        with store.open_input_file(f"{base}/{r.shard}") as f:
            members = media.shard_members(f.read())
        assert sha(media.decode_picture(members[f"{r.digest}.png"])) == r.digest
        assert len(members[f"{r.digest}.png"]) == r.length
    heads = {r.digest: (r.width, r.height, r.bits) for r in media.header_columns(media.place_of(index), root).collect()}
    assert heads == {r.digest: (64, r.payload_bytes // 64, 8) for r in media.payload_columns(media.place_of(index), root).collect()}
    assert media.write_media(docs.limit(0), root).count() == 0


def test_a_payload_is_stored_once(spark, monkeypatch):
    rows = [(i, ["same", "text \0", "text ", f"own {i}"][i % 4]) for i in range(60)] + [(None, "none"), (None, "none again"), (None, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for bound in (100_000, -1):
        monkeypatch.setattr(media, "BROADCAST_COPIES", bound)
        root = fresh_path(spark, "media-once")
        index = media.write_media(docs, root).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.digest) for r in index) == sorted((i or -1, len(t.encode()), sha(pad(t))) for i, t in rows)
        store, base = media._store(root)
        names = []
        for shard in {r.shard for r in index}:
            with store.open_input_file(f"{base}/{shard}") as f:
                names += list(media.shard_members(f.read()))
        assert len(names) == len(set(names)) == len({sha(pad(t)) for _, t in rows})
