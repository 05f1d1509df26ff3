"""Writers of clouds, records and documents."""
