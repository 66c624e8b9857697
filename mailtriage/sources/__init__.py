"""Where mail comes from: object scans, arrival streams, notifications, response tables."""
