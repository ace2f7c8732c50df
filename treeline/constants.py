"""Fixed values of the data model."""

CHUNK = 64 << 20
CHECKSUM_BLOCK = 64 << 10
ROOT = 2
ADLER_MODULUS = 65521
MIN_STRIPE, MAX_STRIPE = 4096, CHUNK
MAX_NAME, MAX_PATH, MAX_REPLICAS = 4096, 12 << 10, 64
LEASE_S, ABANDONED_S, DEDUP_S, HEARTBEAT_S = 300, 1000, 360, 60
UNDEFINED_TIER, MAX_TIER = 127, 15
REBALANCE_FROM, REBALANCE_TO, PLACEMENT_LIMIT = 0.82, 0.72, 0.95
#: Weights of the fixed-point moving averages, of 4096, by their window.
EWMA = {"1m": 3353, "5m": 3706, "15m": 3832, "1h": 4082, "3h": 4089, "6h": 4091}
EWMA_BITS = 12
#: Slots and seconds between them of the retention lists.
RETENTION = ((30, 10), (30, 120), (24, 3600), (30, 86400))
