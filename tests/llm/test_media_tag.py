from waymark.llm import mpeg


def test_payload_with_tag_where_an_id3v1_tag_would_be():
    for n in (1408, 5000):
        for i in range(n - 130, n - 2):
            payload = b"x" * i + b"TAG" + b"x" * (n - i - 3)
            data = mpeg.pack_bytes(payload)
            if data[-128:-125] == b"TAG":
                break
        else:
            raise AssertionError("no payload reaches the place")
        got, plain = mpeg.read_stream(data), mpeg.read_stream(mpeg.pack_bytes(b"x" * n))
        assert got["payload"] == payload and not got["skipped"] and got["offsets"] == plain["offsets"]


def test_a_true_id3v1_tag_is_still_left_out():
    payload = bytes(range(256)) * 9
    data = mpeg.pack_bytes(payload)
    got = mpeg.read_stream(data + b"TAG" + b"t" * 125)
    assert got["payload"] == payload and got["frames"] == mpeg.read_stream(data)["frames"] and not got["skipped"]
