"""Job surface (K4, K5): one request builds and writes one preference table set.

``PreferenceRequest`` carries what a request message carried: uid, name,
algorithm (EPREF engagement, NPREF purchases), rating (explicit, implicit),
source kind and reader arguments, sink and output base.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from affinity.operators.engagement import engagement_ratings, engagement_ratings_explicit
from affinity.operators.purchase import purchase_preferences, purchase_ratings_explicit
from affinity.schemas import EVENT, EVENT_RATING, ORDER_LINE, PURCHASE_RATING
from affinity.sinks import SINKS, write_engagement, write_purchase
from affinity.sources.orderlog import read_log_lines
from affinity.sources.readers import SOURCE_KINDS, read_source
from affinity.tableset import TableSetError, is_committed

ALGORITHMS = ("EPREF", "NPREF")
RATINGS = ("explicit", "implicit")
LOG = "LOG"


@dataclass(frozen=True)
class PreferenceRequest:
    uid: str
    name: str
    algorithm: str
    source: str
    rating: str = "implicit"
    sink: str = "PARQUET"
    output: str = ""
    source_args: dict = field(default_factory=dict)
    scores: object = None  # score table for EPREF: None (default), path, rows or DataFrame
    # Source LOG (purchases from the order-item log): one site and an open time interval.
    site: object = None
    startdate: object = None
    enddate: object = None

    def validate(self) -> None:
        """Raise ``ValueError`` naming the first bad argument."""
        if not self.uid:
            raise ValueError("missing uid")
        if not self.name:
            raise ValueError("missing name")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm '{self.algorithm}', expected one of {ALGORITHMS}")
        if self.source.upper() not in (*SOURCE_KINDS, LOG):
            raise ValueError(f"unknown source '{self.source}', expected one of {(*SOURCE_KINDS, LOG)}")
        if self.source.upper() == LOG:
            if (self.algorithm, self.rating) != ("NPREF", "implicit"):
                raise ValueError("the order-item log gives implicit purchases (NPREF) only")
            for name in ("site", "startdate", "enddate"):
                if getattr(self, name) is None:
                    raise ValueError(f"missing {name}")
        if self.rating not in RATINGS:
            raise ValueError(f"unknown rating '{self.rating}', expected one of {RATINGS}")
        if self.sink.upper() not in SINKS:
            raise ValueError(f"unknown sink '{self.sink}', expected one of {SINKS}")
        if not self.output:
            raise ValueError("missing output base")


    def digest(self) -> str:
        """Identity of what is asked for; a build that failed goes on only for the same request."""
        asked = (self.algorithm, self.source.upper(), self.rating, self.sink.upper(), sorted((k, str(v)) for k, v in self.source_args.items()),
                 str(self.scores), str(self.site), str(self.startdate), str(self.enddate))
        return hashlib.sha256(repr(asked).encode()).hexdigest()


def plan(request: PreferenceRequest, spark: SparkSession) -> DataFrame:
    """Everything about a request that can be told without reading rows; returns the unread input.

    Arguments, the source and its columns, the field spec and its types, and the
    output are resolved by analysis (a Parquet source reads its footers); a mapped
    column that is missing, a cast that cannot be, or a set that is already built raises here.
    """
    request.validate()
    if is_committed(spark, request.output, request.name, request.uid):
        raise TableSetError(f"{request.output}/{request.name}/{request.uid} is already built")
    explicit = request.rating == "explicit"
    if request.source.upper() == LOG:
        data = read_log_lines(spark, site=request.site, start=request.startdate, end=request.enddate,
                              **request.source_args)
    else:
        data = read_source(spark, request.algorithm, request.source, explicit, **request.source_args)
    wanted = (EVENT_RATING if explicit else EVENT) if request.algorithm == "EPREF" else (PURCHASE_RATING if explicit else ORDER_LINE)
    found = {f.name: f.dataType for f in data.schema.fields}
    for f in wanted.fields:
        if found.get(f.name) != f.dataType:
            raise ValueError(f"input field '{f.name}' is {found.get(f.name)}, expected {f.dataType}")
    return data


def build(request: PreferenceRequest, spark: SparkSession) -> dict[int, str]:
    """Plan, read, compute and write; returns the written paths by table number.

    The tables are committed together.  After a failure the same request goes on from the tables that were finished.
    """
    data = plan(request, spark)
    explicit = request.rating == "explicit"
    if request.algorithm == "NPREF":
        prefs = purchase_ratings_explicit(data) if explicit else purchase_preferences(data)
        return {1: write_purchase(prefs, request.output, request.name, request.uid, request.sink, request.digest())}
    ratings = engagement_ratings_explicit(data) if explicit else engagement_ratings(data, request.scores)
    return write_engagement(ratings, request.output, request.name, request.uid, request.sink, request=request.digest())
