"""Control of iteration, vertex programs and the registry of queries."""
