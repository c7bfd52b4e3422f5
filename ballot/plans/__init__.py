"""The index facade and the queries registered with the driver."""
