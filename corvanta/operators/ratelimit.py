"""Leaky buckets over logs of requests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.operators.folds import ordered_fold


class Bucket:
    """A bucket's level in event time."""

    def __init__(self, capacity: float, leak_rate: float):
        if capacity <= 0 or leak_rate <= 0:
            raise ValueError("capacity and leak_rate must be above 0")
        self.capacity, self.leak_rate = capacity, leak_rate
        self.level, self.last = 0.0, None

    def leak(self, now: float) -> None:
        """Let out what leaks until ``now``."""
        if self.last is not None and now > self.last:
            self.level = max(0.0, self.level - (now - self.last) * self.leak_rate)
        if self.last is None or now > self.last:
            self.last = now

    def admit(self, now: float, amount: float = 1.0) -> bool:
        """Leak for the time since the last call, then take ``amount`` if it fits."""
        if not 0 < amount <= self.capacity:
            raise ValueError(f"amount must be above 0 and at most {self.capacity}")
        self.leak(now)
        if self.level + amount > self.capacity:
            return False
        self.level += amount
        return True


class Queue:
    """A bucket before which requests wait in line, each for at most ``timeout`` seconds."""

    def __init__(self, capacity: float, leak_rate: float, timeout: float):
        if timeout < 0:
            raise ValueError("timeout must not be below 0")
        self.bucket, self.timeout, self.free = Bucket(capacity, leak_rate), timeout, -math.inf

    def admit(self, arrival: float, amount: float = 1.0) -> float | None:
        """When the request is admitted; None if that is later than its timeout, and then none behind it waits for it."""
        bucket, begin = self.bucket, max(arrival, self.free)
        if begin - arrival > self.timeout:
            return None
        if bucket.admit(begin, amount):
            self.free = begin
            return begin
        wait = (bucket.level + amount - bucket.capacity) / bucket.leak_rate
        if begin - arrival + wait > self.timeout:
            return None
        self.free = bucket.last = begin + wait
        bucket.level = bucket.capacity
        return self.free


def rate_limit(requests: DataFrame, capacity: float, leak_rate: float, key: str, order: str, ts: str = "ts", amount: float = 1.0, timeout: float = 0.0) -> DataFrame:
    """(key, order, admitted, level, admitted_ts) of each request, in order of (ts, order) for each key.

    A request waits in event time until it fits, for at most ``timeout`` seconds, behind
    the admitted ones before it. Without a timeout none waits. admitted_ts is null for
    those that are turned away. Requests without a key share a bucket.
    """
    Queue(capacity, leak_rate, timeout)
    rows = requests.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))

    def step(queue: Queue, row) -> tuple:
        at = queue.admit(row.micros / 1e6, amount)
        return row.k, row.o, at is not None, queue.bucket.level, None if at is None else row.micros if at == row.micros / 1e6 else round(at * 1e6)

    kinds = [requests.schema[c].dataType.simpleString() for c in (key, order)]
    out = ordered_fold(rows, "k", ["micros", "o"], lambda: Queue(capacity, leak_rate, timeout), step, f"k {kinds[0]}, o {kinds[1]}, admitted boolean, level double, at long")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "admitted", "level", F.timestamp_micros("at").alias("admitted_ts"))
