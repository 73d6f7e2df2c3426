"""JSON Schemas: validation of outputs and generation from variable contracts."""
