"""WAV files in frames: ranges, widths, round trips, aborted writes."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.sources import wav


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(wav.WavSource)
    return spark


def pcm(x, rate=8000, width=2):
    """Bytes of a file of samples (n,) or (n, channels)."""
    x = x if x.ndim == 2 else x[:, None]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        top = (1 << (8 * width - 1)) - 1
        whole = (x * top).round().astype(np.int64)
        if width == 1:
            raw = (whole + 128).astype(np.uint8).tobytes()
        elif width == 3:
            raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in whole.ravel())
        else:
            raw = whole.astype(f"<i{width}").tobytes()
        w.writeframes(raw)
    return out.getvalue()


def whole(rows):
    rows = sorted(rows, key=lambda r: r["frame"])
    assert [r["frame"] for r in rows] == list(range(len(rows)))
    return np.concatenate([r["samples"] for r in rows])


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_widths_channels_and_ranges(source, tmp_path, width, monkeypatch):
    monkeypatch.setattr(wav, "RANGE", 3)
    x = np.random.default_rng(width).uniform(-0.9, 0.9, (1050, 2))
    (tmp_path / "a.wav").write_bytes(pcm(x, width=width))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.wav").write_bytes(b"no audio")
    (tmp_path / "empty.wav").write_bytes(pcm(np.empty(0)))
    df = source.read.format("wav").option("frame", 100).load(str(tmp_path))
    rows = df.collect()
    audio = [r for r in rows if r["path"].endswith("a.wav")]
    assert {r["rate"] for r in audio} == {8000} and max(len(r["samples"]) for r in audio) == 100
    for c in (0, 1):
        assert np.allclose(whole([r for r in audio if r["channel"] == c]), x[:, c], atol=2.1 / 2 ** (8 * width - 1))
    assert [tuple(r)[1:] for r in rows if r["path"].endswith("b.wav")] == [(None,) * 4]
    assert [r["samples"] for r in rows if r["path"].endswith("empty.wav")] == [[]]


def test_a_file_without_a_known_size_goes_on_to_its_end(source, tmp_path):
    x = np.linspace(-0.5, 0.5, 333)
    raw = bytearray(pcm(x))
    raw[40:44] = b"\xff\xff\xff\xff"
    (tmp_path / "a.wav").write_bytes(bytes(raw))
    rows = source.read.format("wav").load(str(tmp_path / "a.wav")).collect()
    assert np.allclose(whole(rows), x, atol=1e-4)


def test_round_trip(source, tmp_path):
    rng = np.random.default_rng(1)
    signals = {f"{k}.wav": rng.uniform(-1, 1, 50 * k + 1) for k in range(6)}
    rows = [(n, 16_000, 0, k, x[i : i + 40].tolist()) for n, x in signals.items() for k, i in enumerate(range(0, len(x), 40))]
    df = source.createDataFrame(rows, wav.SCHEMA).repartition(3, "path").sortWithinPartitions("path", "frame")
    out = tmp_path / "out"
    df.write.format("wav").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(signals)
    got = source.read.format("wav").option("frame", 64).load(str(out)).collect()
    for name, x in signals.items():
        assert np.allclose(whole([r for r in got if r["path"].endswith("/" + name)]), x, atol=1e-4)
        with wave.open(str(out / name)) as w:
            assert w.getnframes() == len(x) and w.getframerate() == 16_000


def test_a_failed_write_leaves_nothing(source, tmp_path):
    rows = [("a.wav", 8000, 0, 0, [0.1]), ("b.wav", 8000, 0, 1, [0.1])]  # the second has no frame 0
    df = source.createDataFrame(rows, wav.SCHEMA).coalesce(1).sortWithinPartitions("path", "frame")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="in order"):
        df.write.format("wav").mode("append").save(str(out))
    assert list(out.iterdir()) == []


def test_frames_go_through_filters(source, tmp_path):
    from brindle.functions import dsp
    from brindle.operators import frames as fr

    x = np.random.default_rng(2).uniform(-0.5, 0.5, 1000)
    (tmp_path / "a.wav").write_bytes(pcm(x))
    df = source.read.format("wav").option("frame", 128).load(str(tmp_path)).filter("rate is not null")
    out = fr.carried(df, ["path", "rate", "channel"], lambda p: [dsp.Gate(8000, -20.0)], size=128)
    assert out.agg(F.sum(F.size("samples"))).first()[0] == 1000
