"""Flow records, addresses, answers and labels derived from an ``events`` table.

Every event becomes one message. Its id decides what kind of message: most are
whole flows, the rest are of another type, lack a field, hold an address that is none
or are no JSON, as in real traffic. The
``events`` must have the columns ``event_id, ts, user_id, event_type``.
"""

from pyspark.sql import DataFrame

_ADDRESS = "concat('10.', (user_id div 256) % 256, '.', user_id % 256, '.', event_id % 256)"

_MESSAGE = rf"""
CASE WHEN event_id % 97 = 0 THEN 'not json' ELSE to_json(named_struct(
  '@timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
  'type', CASE WHEN event_id % 13 = 5 THEN 'dns' ELSE 'flow' END,
  'source', CASE WHEN event_id % 20 <> 10 THEN named_struct(
    'ip', CASE WHEN event_id % 20 = 0 THEN NULL
      WHEN event_id % 101 = 7 THEN '10.0.0.300' ELSE {_ADDRESS} END,
    'port', CASE WHEN event_id % 109 <> 13 THEN cast(1024 + event_id % 60000 AS int) END) END,
  'dest', named_struct(
    'ip', CASE WHEN event_id % 107 = 11 THEN NULL WHEN event_id % 103 = 9 THEN 'fe80::1'
      ELSE concat(192 + event_id % 8, '.168.', user_id % 256, '.1') END,
    'port', CASE WHEN event_id % 10 <> 1 THEN
      element_at(array(53, 80, 443, 8080), cast(1 + event_id % 4 AS int)) END),
  'json', CASE WHEN event_id % 20 = 0 THEN named_struct(
    'src_ip', concat('172.16.0.', event_id % 256), 'dest_ip', '8.8.8.8') END)) END
"""

# Eleven of sixteen events write their address in a way that is no dotted quad.
_WRITTEN_ADDRESS = f"""
CASE event_id % 16
  WHEN 0 THEN ''
  WHEN 1 THEN NULL
  WHEN 2 THEN concat({_ADDRESS}, ' x')
  WHEN 3 THEN concat(' ', {_ADDRESS})
  WHEN 4 THEN concat('10.', user_id % 256, '.', event_id % 256)
  WHEN 5 THEN '0x0a.1'
  WHEN 6 THEN concat('0', {_ADDRESS})
  WHEN 7 THEN concat('10.0.0.', 256 + event_id % 256)
  WHEN 8 THEN '::1'
  WHEN 9 THEN concat({_ADDRESS}, '.1')
  WHEN 10 THEN concat('-', {_ADDRESS})
  ELSE {_ADDRESS} END
"""

_ANSWERS = """
CASE WHEN event_type = 'purchase' THEN array('true', 'false')
  WHEN event_type = 'error' THEN array('true')
  WHEN event_id % 7 = 0 THEN array('True')
  ELSE array('false') END
"""


def messages(events: DataFrame, *also: str) -> DataFrame:
    """``(key, ts, value)`` with the event id as key, plus the columns in ``also``."""
    return events.selectExpr(
        "cast(event_id AS string) AS key", "ts", *also, f"{_MESSAGE} AS value"
    )


def addresses(events: DataFrame) -> DataFrame:
    """``(event_id, source_ipv4, dest_ipv4)``; most source addresses are malformed."""
    return events.selectExpr(
        "event_id",
        f"{_WRITTEN_ADDRESS} AS source_ipv4",
        "concat(192 + event_id % 8, '.168.', user_id % 256, '.1') AS dest_ipv4",
    )


def submissions(events: DataFrame) -> DataFrame:
    """``(id, answer)``: every event is answered, a purchase twice.

    One answer in three is for a negative id, which no candidate ever has.
    """
    return events.selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN -event_id - 1 ELSE event_id END AS id",
        f"explode({_ANSWERS}) AS answer",
    )
