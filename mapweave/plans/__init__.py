"""From a configuration document to a plan over a DataFrame of payloads."""
