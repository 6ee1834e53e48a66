import pytest

from brindle.sources import datagen

#: Draws of the published generator with seed 42, without nulls and with every second value null.
GOLDEN = {
    "int8": ([-103, -59, 100, 43], [None, 100, 107, None]), "int16": ([-10749, 12122, -13940, 13734], [None, -13940, 9956, None]), "int32": ([10069, 15486, 47198, 65992], [None, 47198, 2688, None]),
    "int64": ([6537075431, 6537064074, 8895380614, 8957865377], [None, 8895380614, 3170207081, None]), "uint8": ([10, 112, 119, 8], [None, 119, 176, None]), "uint16": ([4251, 27122, 1060, 28734], [None, 1060, 24956, None]),
    "uint32": ([537075412, 1462979770, 432664910, 575421168], [None, 432664910, 1387894643, None]), "uint64": ([2537075424, 634282459, 2721862225, 2564448798], [None, 2721862225, 1001839916, None]),
    "bool": ([True, False, True, True], [None, True, True, None]),
    "float64": ([0.0, 1.23456789, 2.46913578, 3.7037036699999994], [None, 1.23456789, None, 3.7037036699999994]), "float32": ([0.0, 1.2345678806304932, 2.4691357612609863, 3.7037036418914795], [None, 1.2345678806304932, None, 3.7037036418914795]),
    "string": (["c_0000000", "c_0000001", "c_0000002", "c_0000003"], [None, "c_0000001", None, "c_0000003"]), "time": ([0, 4033000000000, 8066000000000, 12099000000000], [None, 4033000000000, None, 12099000000000]),
    "duration": ([0, 1000, 2000, 3000], [None, 1000, None, 3000]), "binary": (["eb", "fe53", "4de722", "a23f0f0b"], [None, "534d", "22a23f", "0b7b55d5"]),
    "uuid": (["eb6ad3d50a000040be1603f4fbeb0ab0", "536f57bfb3bd0d408d75820afd7d6fdd", "e7826d1b53409d48a20023d6b6a1a77a", "a20e0f4e12ff844cbff8faf8b76a5c55"], [None, "536f57bfb3bd0d408d75820afd7d6fdd", "220023d6b6a1a74aa20e0f4e12ff843c", None]),
    "serial": ([1, 2, 3, 4], [1, 2, 3, 4]),
}


@pytest.mark.parametrize("kind", GOLDEN)
@pytest.mark.parametrize("share", [0, 1])
def test_published_draws(spark, kind, share):
    rows = datagen.create_df(spark, {"c": kind}, 4, null_fraction=share * 0.5).collect()
    assert [bytes(r.c).hex() if isinstance(r.c, (bytes, bytearray)) else r.c for r in rows] == GOLDEN[kind][share]


def test_columns_share_one_stream_and_seed_is_odd(spark):
    rows = datagen.create_df(spark, {"a": "int", "b": "INTEGER"}, 3, seed=43).collect()
    assert [r.a for r in rows] == [10069, 15486, 47198] and [r.b for r in rows] == [65992, 2688, 33926]


def _serial(seed, kinds, rows, share):
    state, out = seed | 1, []

    def draw():
        nonlocal state
        state ^= state << 13 & (1 << 64) - 1
        state ^= state >> 7
        state ^= state << 17 & (1 << 64) - 1
        return state

    for kind in kinds:
        column = []
        for i in range(rows):
            if share > 0 and kind != "serial" and (draw() >> 11) * 2.0**-53 < share:
                column.append(None)
            elif kind in datagen.INTEGERS:
                low, high, *_ = datagen.INTEGERS[kind]
                column.append(low + draw() % (high - low + 1))
            elif kind == "bool":
                column.append(bool(draw() & 1))
            elif kind == "binary":
                column.append(bytes(draw() & 255 for _ in range(1 + i % 16)))
            else:
                column.append(i + 1 if kind == "serial" else i * 1000)
        out.append(column)
    return list(zip(*out))


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_blocks_join_up_with_a_serial_generator(spark, share):
    kinds, rows = ["int64", "binary", "duration", "bool", "serial", "uint8", "binary"], 2 * datagen.BLOCK + 77
    frame = datagen.create_df(spark, {f"c{k}": kind for k, kind in enumerate(kinds)}, rows, seed=7, null_fraction=share, partitions=3)
    found = [tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in frame.orderBy("c4").collect()]
    assert found == _serial(7, kinds, rows, share)


def test_hashed_mode(spark):
    schema = {n: n for n in ("int8", "uint64", "bool", "binary", "uuid", "string", "date", "serial")}
    a = datagen.create_df(spark, schema, 1000, null_fraction=0.2, exact=False, partitions=2).orderBy("serial").collect()
    assert a == datagen.create_df(spark, schema, 1000, null_fraction=0.2, exact=False, partitions=5).orderBy("serial").collect()
    assert 120 < sum(r.int8 is None for r in a) < 280 and all(r.serial for r in a)
    assert all(-120 <= r.int8 <= 120 for r in a if r.int8 is not None)
    assert all(r.uuid[6] >> 4 == 4 or r.uuid[7] >> 4 == 4 for r in a if r.uuid is not None)


def test_bad_arguments(spark):
    for schema, rows, share in (({"a": "int"}, 0, 0), ({"a": "int"}, 1, 1.5), ({}, 1, 0), ({"a": "money"}, 1, 0)):
        with pytest.raises(ValueError):
            datagen.create_df(spark, schema, rows, null_fraction=share)
    assert "uuid" in datagen.supported_types()
