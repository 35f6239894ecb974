"""Command line: ``python -m meterlark generate|batch|stream ...``."""

from __future__ import annotations

import argparse

from meterlark.session import build_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="meterlark")
    out.add_argument("--master")
    out.add_argument("--shuffle-partitions", type=int)
    verbs = out.add_subparsers(dest="verb", required=True)
    make = verbs.add_parser("generate", help="write synthetic events to files, or to a broker's topic")
    make.add_argument("--out")
    make.add_argument("--count", type=int, default=10_000)
    make.add_argument("--hours", type=int, default=24)
    make.add_argument("--seed", type=int, default=42)
    make.add_argument("--duplicate-rate", type=float, default=0.02)
    make.add_argument("--late-rate", type=float, default=0.05)
    make.add_argument("--abuse-rate", type=float, default=0.03)
    make.add_argument("--format", choices=("json", "parquet"), default="json")
    run = verbs.add_parser("batch", help="JSON files to Bronze, Silver and Gold")
    run.add_argument("--input", required=True)
    run.add_argument("--out", required=True)
    live = verbs.add_parser("stream", help="the streaming chain from a folder or a broker's topic")
    live.add_argument("--input", help="folder of message files, unless a broker is given")
    live.add_argument("--out", required=True, help="root of the tables and, unless given, of the checkpoints")
    live.add_argument("--checkpoints")
    live.add_argument("--interval", help="keep running with this trigger, for instance '1 minute'")
    live.add_argument("--watermark", default="1 hour")
    live.add_argument("--max-files", type=int, help="files of a batch at most")
    live.add_argument("--with-metrics", action="store_true", help="quality and health tables beside the layers")
    live.add_argument("--counters", help="where the latest counts go, as JSON")
    live.add_argument("--starting-offsets", default="earliest")
    live.add_argument("--max-offsets", type=int, help="offsets of a batch at most")
    for verb in (make, live):
        verb.add_argument("--brokers")
        verb.add_argument("--topic", default="api-usage-events.v1")
    return out


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    if given.verb == "generate" and not (given.out or given.brokers) or given.verb == "stream" and not (given.input or given.brokers):
        parser().error("a folder or a broker is needed")
    spark = build_session(master=given.master, shuffle_partitions=given.shuffle_partitions)
    if given.verb == "generate":
        from meterlark.plans.batch import write_events
        from meterlark.sources.adapter import nested_events
        from meterlark.sources.generator import generate
        from meterlark.sources.readers import send_messages, to_messages

        flat = generate(spark, given.count, hours=given.hours, seed=given.seed, duplicates=given.duplicate_rate, late=given.late_rate, abuse=given.abuse_rate)
        if given.brokers:
            send_messages(to_messages(nested_events(flat).orderBy("event_timestamp")), given.brokers, given.topic)
        else:
            write_events(nested_events(flat) if given.format == "json" else flat, given.out, given.format)
    elif given.verb == "batch":
        from meterlark.plans import batch

        for name, table in batch.run(spark, given.input, given.out).items():
            print(name, table.count())
    else:
        from meterlark.streaming import runner

        options = runner.Options(
            given.interval, given.max_files, given.watermark, given.brokers, given.topic, given.starting_offsets, given.max_offsets, given.with_metrics, given.counters
        )
        (runner.run_forever if given.interval else runner.run_all)(spark, given.input, given.out, options, given.checkpoints)


if __name__ == "__main__":
    main()
