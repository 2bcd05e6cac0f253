"""Speakers of a video's segments as one list: who is known from earlier segments keeps the id, who is new gets one.

The list of a video depends on the order of its segments, so it is a state that
goes from row to row.  ``map_segments`` carries it along a sorted table, as a batch;
``map_segment_stream`` keeps it in the state store between the batches of a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.fuzzy import ratio

#: A known name must be more alike than this.
LEAST = 80
COLUMNS = ["video_id", "segment", "place", "voice", "name", "position", "role_in_video"]
OUT = "video_id string, segment long, place long, voice long, name string, position string, role_in_video string, speaker_id string, is_new boolean"
_STATE = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("ids", "names")])


class Known:
    """The known speakers of a video: names by id, in the order in which they came."""

    def __init__(self, names: dict[str, str] | None = None) -> None:
        self.names = dict(names or {})

    def resolve(self, name: str | None) -> tuple[str, bool]:
        """(id, whether it is new) of a name, which becomes the id's name.

        The known name most alike counts, of equals the one known longest, if it is
        more than LEAST alike.  Else the id is made from the name, with the least
        number from 1 that no speaker with a name has.
        """
        name = name or ""
        best, most = None, 0.0
        for own, known in self.names.items():
            if known and (points := ratio(name.lower(), known.lower())) > most:
                best, most = own, points
        fresh = best is None or most <= LEAST
        if fresh:
            base = "s_" + re.sub("[^a-z0-9_]", "", name.lower().replace(" ", "_").replace("'", ""))
            number = 1
            while self.names.get(f"{base}_{number}"):
                number += 1
            best = f"{base}_{number}"
        self.names[best] = name
        return best, fresh


def _resolved(rows: pd.DataFrame, known: Known) -> pd.DataFrame:
    found = [known.resolve(name if isinstance(name, str) else None) for name in rows["name"]]
    return rows[COLUMNS].assign(speaker_id=[f[0] for f in found], is_new=[f[1] for f in found])


def _shaped(rows: DataFrame) -> DataFrame:
    kinds = {"segment": "long", "place": "long", "voice": "long"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def map_segments(rows: DataFrame) -> DataFrame:
    """``rows`` (COLUMNS: a speaker of a segment, ``place`` in it) with ``speaker_id`` and ``is_new``.

    Each video is one sequence, by segment, place, voice and name; a task reads its
    videos as sorted batches and holds the known speakers of one, not its rows.
    A null name is an empty one, which is never alike to anything.
    """
    dealt = _shaped(rows).repartition("video_id").sortWithinPartitions("video_id", "segment", "place", "voice", "name")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, known = object(), Known()
        for batch in batches:
            keys = batch["video_id"].map(lambda v: v if isinstance(v, str) else None)
            starts = [0, *[i for i in range(1, len(batch)) if keys.iat[i] != keys.iat[i - 1]], len(batch)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a < b:
                    if keys.iat[a] != video:
                        video, known = keys.iat[a], Known()
                    yield _resolved(batch.iloc[a:b], known)

    return dealt.mapInPandas(carry, OUT)


def map_segment_stream(rows: DataFrame) -> DataFrame:
    """As ``map_segments``, of a stream, for the output mode ``append``.

    A batch's rows of a video are taken in order; segments of a later batch come
    after those of earlier ones.  Where segments arrive in order, the result is that
    of the batch.
    """

    def carry(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, names = state.get if state.exists else ([], [])
        known = Known(dict(zip(ids, names, strict=True)))
        every = pd.concat(list(batches)).sort_values(["segment", "place", "voice", "name"], kind="stable")
        yield _resolved(every, known)
        state.update((list(known.names), list(known.names.values())))

    return _shaped(rows).groupBy("video_id").applyInPandasWithState(carry, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
