"""Writers: scan log, quarantine, manifest, bundles, encryption."""
