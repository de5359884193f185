"""Relations of a discussion archive: schemas, readers, adapters and sinks."""
