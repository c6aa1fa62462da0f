"""Model calls as one batched operator over a table of requests."""
