"""Schemas and constants of the burst data model."""

from __future__ import annotations

# Reserved cluster ids, the offset of ids in files, and pseudo or special event types.
UNCLASSIFIED, MISSING, DURATION_FILTERED, RANGE_FILTERED, THRESHOLD_FILTERED, NOISE = -5, -4, -3, -2, -1, 0
FILE_OFFSET = 5
COMPLETE_BURST, MISSING_DATA, DURATION_BURST, RANGE_BURST = 0, 1, 2, 3
DURATION_TYPE, SEMANTIC_TYPE, COUNTER_SET_TYPE, CLUSTER_EVENT = 1, 2, 41999999, 90000001
COUNTER_RANGE = (42000000, 42009999)
OVERFLOW_TYPES = (42001226, 42001219)
LOG_OF_ZERO = 2.2250738585072014e-308
RUNNING = 1

STATE_FIELDS = ["cpu", "app", "task", "thread", "begin", "end", "state"]
EVENT_FIELDS = ["cpu", "app", "task", "thread", "ts"]
COMM_FIELDS = ["src_cpu", "src_app", "src_task", "src_thread", "log_send", "phy_send", "dst_cpu", "dst_app", "dst_task", "dst_thread", "log_recv", "phy_recv", "size", "tag"]
GLOBALOP_FIELDS = ["cpu", "app", "task", "thread", "ts", "communicator", "send_size", "recv_size", "op_id", "root"]
