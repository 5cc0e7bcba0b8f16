"""Tables kept between runs and the incremental job."""
