import hashlib
import zlib

import numpy as np

from siltstone.llm import avi


def test_frames_are_lossless_and_general_decoder_agrees():
    samples = np.random.default_rng(0).integers(0, 256, (4, 576), dtype=np.uint8)
    samples[1] = 255
    frames = avi.encode_frames(samples)
    assert (avi.decode_own(frames) == samples).all()
    fast = avi.inverse_dct(avi.coefficients(samples).reshape(-1, 64)).reshape(4, 3, 3, 8, 8).transpose(0, 1, 3, 2, 4).reshape(4, 24, 24)
    assert (fast == np.array([avi.decode_jpeg(f) for f in frames])).all()


def test_riff_index():
    frames = [b"abc", b"defg", b""]
    data = avi.mux(frames)
    assert avi.demux(data) == (frames, 40_000)
    assert avi.demux(data[: data.index(b"idx1")])[0] == frames


def test_shots():
    counts = np.zeros((12, 16), int)
    counts[:6, 0] = counts[6:, 9] = 576
    assert avi.shot_starts(counts)[0] == [0, 6]
    assert avi.shot_starts(counts[:1])[0] == [0]


def test_table(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("source", "media")
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = avi.read_features(avi.to_media(docs)).collect()
    assert len(got) == docs.count()
    seen = set()
    for key, text in texts:
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        seen.add((key, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert {tuple(r)[:5] for r in got} == seen
    assert avi.read_features(avi.to_media(no_docs)).count() == 0
    clips = avi.clips(avi.to_media(docs)).collect()
    assert {c["doc_id"] for c in clips} == {k for k, _ in texts} and all(c["end_ms"] > c["start_ms"] for c in clips)


def plain_feature(payload):
    """Brute force: a slow inverse DCT by its definition, histograms and the shot rule, in plain Python."""
    import math

    counts = []
    for f in range(0, len(payload), 576):
        bins = [0] * 16
        for b in range(9):
            co = [[0] * 8 for _ in range(8)]
            for k, z in enumerate(avi.ZIGZAG.tolist()):
                v = payload[f + 64 * b + k]
                co[z // 8][z % 8] = v - 255 if v < 128 else v
            base = [[round((0.5 / math.sqrt(2) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) * 4096) for x in range(8)] for u in range(8)]
            for y in range(8):
                for x in range(8):
                    total = sum(co[v][u] * base[u][x] * base[v][y] for v in range(8) for u in range(8))
                    bins[min(255, max(0, ((total + (1 << 23)) >> 24) + 128)) >> 4] += 1
        counts.append(bins)
    share = [sum(abs(p - q) for p, q in zip(a, b, strict=True)) / 1152 for a, b in zip(counts, counts[1:], strict=False)]
    cuts = []
    for k, d in enumerate(share):
        past = share[max(0, k - 8) : k]
        mean = sum(past) / len(past) if past else 0.0
        bar = max(0.1, mean + 2 * math.sqrt(sum((p - mean) ** 2 for p in past) / len(past))) if past else 0.1
        if d > bar:
            cuts.append(k + 1)
    digest = zlib.crc32(b"".join(c.to_bytes(4, "little") for bins in counts for c in bins))
    return f"frames={len(counts)};clips={len(cuts) + 1};cuts={','.join(map(str, cuts))};peak={max(share, default=0.0):.6f};hist={digest:08x}"


def test_features_against_plain_python(spark):
    texts = ["", "short", "word and more " * 120, "aaaa" * 400 + "\xff\xfe zzz" * 300, "".join(chr(32 + (k * k) % 90) for k in range(4000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["feature"] for r in avi.read_features(avi.to_media(docs)).collect()}
    for k, text in enumerate(texts):
        data = text.encode()
        assert got[k] == plain_feature(data + b"\xff" * (-len(data) % 576 or (0 if data else 576)))


def test_null_foreign_and_broken_media(spark):
    samples = np.random.default_rng(0).integers(0, 256, (3, 576), dtype=np.uint8)
    own = avi.mux(avi.encode_frames(samples))
    # A foreign file: the same frames behind another header (a comment segment is added).
    foreign = avi.mux([f[:2] + b"\xff\xfe\x00\x04hi" + f[2:] for f in avi.encode_frames(samples)])
    media = {1: None, 2: b"", 3: b"no avi at all", 4: avi.mux([]), 5: foreign, 6: own, 7: own[: len(own) // 2], 8: own[:40] + b"\x00" * 400, 9: avi.mux([avi.HEAD, avi.HEAD + b"\x01" * 7]), 10: avi.mux([b"\xff\xd8\xff"])}
    table = spark.createDataFrame([(k, 1, m) for k, m in media.items()], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in avi.read_features(table.coalesce(1)).collect()}
    assert set(got) == set(media)
    for k in (1, 2, 3, 9, 10):
        assert got[k]["feature"] is None and got[k]["payload_sha256"] is None, k
    assert got[4]["feature"].startswith("frames=0;clips=0")
    assert got[5]["feature"] == got[6]["feature"] and got[5]["payload_bytes"] is None
    assert got[6]["payload_sha256"] == hashlib.sha256(samples.tobytes()).hexdigest()
    assert {c["doc_id"] for c in avi.clips(table).collect()} >= {5, 6} and not {c["doc_id"] for c in avi.clips(table).collect()} & {1, 2, 3, 4, 9, 10}


def test_shots_of_frames_of_other_sizes():
    counts = np.zeros((6, 16), int)
    counts[:3, 0], counts[3:, 0] = 576, 64
    assert avi.shot_starts(counts) == ([0], 0.0)
